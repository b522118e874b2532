"""Raw files, versions, contract checks, silver, quality gate and acquisition summary."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from vintageline.functions.columns import weighted_mean
from vintageline.operators.acquisition import (
    METRICS,
    acquisition_summary,
    latest_per_loan,
    observed_quarters,
    population_differences,
    published_table,
    quarter_frame,
    summary_differences,
    PUBLISHED_QUARTERS,
    PUBLISHED_ROWS,
)
from vintageline.operators.checks import (
    digit_report,
    split_lines,
    text_length_report,
    violations,
    width_counts,
)
from vintageline.operators.quality import quality_report, repeated_key_rows
from vintageline.operators.silver import (
    keep_latest,
    label_codes,
    numbered_spells,
    servicer_spells,
    silver_table,
    type_columns,
)
from vintageline.plans.publication import merge_months, publish_gold, publish_silver
from vintageline.queries.inputs import panel, query, releases, rounded, table, use_scratch
from vintageline.queries.twins import PANEL, with_panel, with_survival
from vintageline.sources.contract import DEFAULT_WIDTH, fields_of_width, raw_schema
from vintageline.sources.rawfiles import ingest, read_bronze, read_raw, scan_files
from vintageline.sources.releases import load_releases
from vintageline.sources.snapshots import publish, read_version, source_versions
from vintageline.sources.synthetic import raw_lines, write_raw_files, write_raw_lines

LOADED_AT = datetime(2026, 1, 1, tzinfo=UTC)


def _raw_folder(spark, folder) -> str:
    """Raw files of the whole panel, written by the cluster under its shared folder."""
    target = f"{use_scratch(spark)}/raw"
    write_raw_files(panel(spark, folder), target)
    return target


def _bronze(spark, folder) -> str:
    raw = _raw_folder(spark, folder)
    bronze = f"{raw}-bronze"
    ingest(spark, [raw], bronze, ingested_at=LOADED_AT)
    return bronze


# Sources and sinks.


@query(
    "src2_raw_file_read",
    with_panel(
        """SELECT STATE, strftime(ACT_PERIOD, '%m%Y') AS ACT_PERIOD, count(*) AS rows,
        CAST(sum(OLTV) AS BIGINT) AS oltv, count(CSCORE_C) AS with_coborrower FROM panel GROUP BY 1, 2"""
    ),
)
def src2_raw_file_read(spark, folder):
    """Write the panel as raw text, read it back through the positional schema."""
    raw = read_raw(spark, [_raw_folder(spark, folder)])
    return raw.groupBy("STATE", "ACT_PERIOD").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("OLTV").cast("bigint")).alias("oltv"),
        F.count("CSCORE_C").alias("with_coborrower"),
    )


@query(
    "src3_bronze_provenance",
    with_panel(
        """SELECT _source_file AS source_file, count(*) AS rows, 108 AS field_count, true AS named, true AS hashed,
        CAST('2026-01-01' AS DATE) AS loaded_on FROM panel GROUP BY 1"""
    ),
)
def src3_bronze_provenance(spark, folder):
    return read_bronze(spark, _bronze(spark, folder)).groupBy(F.col("_source_file").alias("source_file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("_source_field_count").alias("field_count"),
        (F.count("_source_path") == F.count(F.lit(1))).alias("named"),
        (F.max(F.length("_source_sha256")) == 64).alias("hashed"),
        F.max(F.to_date("_ingested_at")).alias("loaded_on"),
    )


@query(
    "src4_width_counts",
    with_panel(
        """SELECT CASE WHEN STATE='NY' THEN 107 WHEN STATE='WA' THEN 109 ELSE 108 END AS field_count,
        count(*) AS line_count FROM panel GROUP BY 1"""
    ),
)
def src4_width_counts(spark, folder):
    """Field counts of raw lines, after one delimiter is taken from or given to some lines."""
    rows = panel(spark, folder)
    lines = raw_lines(rows)
    state = F.get(F.split("value", r"\|", -1), F.lit(30))
    damaged = (
        F.when(state == "NY", F.regexp_replace("value", r"\|$|\|(?=[^|]*$)", ""))
        .when(state == "WA", F.concat("value", F.lit("|")))
        .otherwise(F.col("value"))
    )
    return width_counts(lines.select(damaged.alias("value")))


@query(
    "src5_replay_counts",
    with_panel(
        """SELECT 1 AS run, 6 AS ingested, 0 AS skipped, count(*) AS rows_written, count(*) AS final_rows FROM panel
        UNION ALL SELECT 2, 0, 6, 0, count(*) FROM panel"""
    ),
)
def src5_replay_counts(spark, folder):
    """Ingest all files, then replay them: nothing is added."""
    raw = _raw_folder(spark, folder)
    runs = [ingest(spark, [raw], f"{raw}-bronze", ingested_at=LOADED_AT) for _ in range(2)]
    rows = [
        (i, r.files_ingested, r.files_skipped, r.rows_written, r.final_rows)
        for i, r in enumerate(runs, start=1)
    ]
    return spark.createDataFrame(
        rows, "run int, ingested int, skipped int, rows_written bigint, final_rows bigint"
    )


@query(
    "src6_file_fingerprints",
    with_panel(
        "SELECT _source_file AS file_name, count(*) AS line_count, true AS repeatable FROM panel GROUP BY 1"
    ),
)
def src6_file_fingerprints(spark, folder):
    """Line counts per file and whether two scans agree on every fingerprint."""
    raw = _raw_folder(spark, folder)
    first = scan_files(spark, [raw])
    again = scan_files(spark, [raw]).select("path", F.col("fingerprint").alias("again"))
    return first.join(again, "path").groupBy("file_name").agg(
        F.sum("line_count").alias("line_count"),
        F.bool_and(F.col("fingerprint") == F.col("again")).alias("repeatable"),
    )


@query(
    "src7_mixed_width_bronze",
    with_panel(
        """SELECT w.width AS field_count, count(*) AS rows, count(DISTINCT _source_file) AS files,
        CASE WHEN w.width = 113 THEN count(*) ELSE 0 END AS with_last FROM panel, (VALUES (108), (113)) w(width)
        GROUP BY w.width"""
    ),
)
def src7_mixed_width_bronze(spark, folder):
    """Ingest the narrow layout, then the widest with its last column filled: both read back whole."""
    narrow = _raw_folder(spark, folder)
    bronze, wide = f"{narrow}-bronze", f"{narrow}-wide"
    lines = raw_lines(panel(spark, folder), 113).select(F.concat("value", F.lit("L")).alias("value"), "quarter")
    write_raw_lines(lines, wide)
    ingest(spark, [narrow], bronze, ingested_at=LOADED_AT)
    ingest(spark, [wide], bronze, 113, ingested_at=LOADED_AT)
    stored = read_bronze(spark, bronze)
    return stored.groupBy(F.col("_source_field_count").alias("field_count")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("_source_file").alias("files"),
        F.count_if(F.col(raw_schema(113).names[-1]) == "L").alias("with_last"),
    )


@query(
    "src8_pinned_versions",
    with_panel(
        """SELECT 0 AS version, count(*) AS rows, max(ACT_PERIOD) AS last_month, CAST(0 AS BIGINT) AS built_from FROM panel
        WHERE ACT_PERIOD <= DATE '2012-12-01'
        UNION ALL SELECT 1, count(*), max(ACT_PERIOD), 1 FROM panel"""
    ),
)
def src8_pinned_versions(spark, folder):
    """Two published versions, each still readable at its own number."""
    rows = panel(spark, folder)
    path = f"{use_scratch(spark)}/panel"
    publish(rows.where(F.col("ACT_PERIOD") <= F.lit(date(2012, 12, 1))), path, {"seed": 0})
    publish(rows, path, {"seed": 1}, sort_by=("LOAN_ID", "ACT_PERIOD"))
    parts = [
        read_version(spark, path, v).agg(
            F.lit(v).alias("version"),
            F.count(F.lit(1)).alias("rows"),
            F.max("ACT_PERIOD").alias("last_month"),
            F.lit(source_versions(spark, path, v)["seed"]).cast("bigint").alias("built_from"),
        )
        for v in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "src9_release_archive",
    """SELECT 'UNRATE' AS SERIES_ID, CAST(date_trunc('month', o_orderdate) AS DATE) AS OBSERVATION_DATE,
    CAST(date_trunc('month', o_orderdate) + to_days(34) AS DATE) AS AVAILABLE_DATE, CAST(count(*) AS DOUBLE) AS VALUE
    FROM orders GROUP BY 2, 3 HAVING count(*) % 7 <> 0""",
)
def src9_release_archive(spark, folder):
    """Monthly order counts written as a JSON release file and parsed; some months are ``.`` gaps."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    monthly = table(spark, folder, "orders").groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(
        F.date_format("m", "yyyy-MM-dd").alias("date"),
        F.date_format(F.date_add("m", 34), "yyyy-MM-dd").alias("realtime_start"),
        F.when(F.col("n") % 7 == 0, ".").otherwise(F.col("n").cast("string")).alias("value"),
    )
    archive = f"{use_scratch(spark)}/archive"
    # One entry per month, so the single document is bounded by the calendar.
    monthly.agg(F.collect_list(entry).alias("observations")).write.json(f"{archive}/UNRATE.json")
    loaded = load_releases(spark, archive, ("UNRATE",))
    return loaded.withColumn("VALUE", F.col("VALUE").cast("double"))


@query(
    "snk3_release_counts",
    """SELECT 'UNRATE' AS SERIES_ID, count(*) AS rows FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders)""",
)
def snk3_release_counts(spark, folder):
    """Rows per series of a published release table made from the order months."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = (
        table(spark, folder, "orders")
        .groupBy(month.alias("OBSERVATION_DATE"))
        .agg(F.avg("o_totalprice").cast("decimal(20,6)").alias("VALUE"))
        .select(F.lit("UNRATE").alias("SERIES_ID"), "OBSERVATION_DATE", F.date_add("OBSERVATION_DATE", 34).alias("AVAILABLE_DATE"), "VALUE")
    )
    path = f"{use_scratch(spark)}/macro"
    version = publish(rows, path)
    return read_version(spark, path, version).groupBy("SERIES_ID").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "srv7_published_gold",
    with_survival(
        """SELECT 'silver' AS layer, (SELECT count(*) FROM panel) AS rows
        UNION ALL SELECT 'servicer', (SELECT count(*) FROM (SELECT LOAN_ID, SERVICER,
            lag(SERVICER) OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD) AS b FROM panel) WHERE b IS DISTINCT FROM SERVICER)
        UNION ALL SELECT 'gold', (SELECT count(*) FROM surv)"""
    ),
)
def srv7_published_gold(spark, folder):
    """Raw text to Bronze, Silver, servicer history and Gold; rows per published layer (SRV7, SRV8)."""
    bronze = _bronze(spark, folder)
    silver_path, servicer_path, gold_path = (f"{bronze}-{n}" for n in ("silver", "servicer", "gold"))
    silver_run = publish_silver(spark, bronze, silver_path, servicer_path)
    silver = read_version(spark, silver_path, silver_run.version)
    gold_run = publish_gold(spark, silver, releases(spark), gold_path, {"silver": silver_run.version, "macro": 0})
    parts = None
    for layer, path, version in (
        ("silver", silver_path, silver_run.version),
        ("servicer", servicer_path, 0),
        ("gold", gold_path, gold_run.version),
    ):
        row = read_version(spark, path, version).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(layer).alias("layer"), "rows")
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query(
    "x16_month_merge",
    with_panel("SELECT ACT_PERIOD, count(*) AS rows, count(DISTINCT LOAN_ID) AS loans FROM panel GROUP BY 1"),
)
def x16_month_merge(spark, folder):
    """Load two sets of vintages that share months, then replay a range of months of one of them twice."""
    rows = panel(spark, folder).select("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS")
    path = f"{use_scratch(spark)}/monthly"
    later = F.col("LOAN_ID").rlike("[02468]$")
    merge_months(rows.where(~later), path)
    merge_months(rows.where(later), path)
    rows = rows.where(later)
    replay = rows.where(F.col("ACT_PERIOD").between(F.lit(date(2012, 1, 1)), F.lit(date(2013, 12, 1))))
    merge_months(replay, path)
    merge_months(replay, path)
    stored = spark.read.parquet(path).groupBy("ACT_PERIOD", "LOAN_ID").agg(F.count(F.lit(1)).alias("n"))
    return stored.groupBy("ACT_PERIOD").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("loans"))


# Contract checks.

_DAMAGED = """, damaged AS (
  SELECT LOAN_ID,
    CASE WHEN STATE='CA' AND LOAN_AGE=4 THEN '13' || strftime(ACT_PERIOD, '%Y') ELSE strftime(ACT_PERIOD, '%m%Y') END AS ACT_PERIOD,
    CASE WHEN STATE='FL' AND LOAN_AGE=2 THEN 'x' || CAST(DTI AS VARCHAR) ELSE CAST(DTI AS VARCHAR) END AS DTI,
    CASE WHEN STATE='GA' AND LOAN_AGE=3 THEN CAST(CAST(ORIG_UPB AS BIGINT) AS VARCHAR) || '.125'
         WHEN STATE='IL' AND LOAN_AGE=3 THEN 'NaN' ELSE CAST(CAST(ORIG_UPB AS BIGINT) AS VARCHAR) || '.00' END AS ORIG_UPB
  FROM panel
), broken AS (
  SELECT LOAN_ID AS ROW_LOAN_ID, ACT_PERIOD AS ROW_ACT_PERIOD, 'ACT_PERIOD' AS column_name, 'month' AS rule, ACT_PERIOD AS value
    FROM damaged WHERE NOT regexp_full_match(ACT_PERIOD, '[0-9]{6}') OR try_strptime(ACT_PERIOD, '%m%Y') IS NULL
  UNION ALL SELECT LOAN_ID, ACT_PERIOD, 'DTI', 'integer', DTI FROM damaged WHERE TRY_CAST(DTI AS INT) IS NULL
  UNION ALL SELECT LOAN_ID, ACT_PERIOD, 'ORIG_UPB', CASE WHEN regexp_full_match(ORIG_UPB, '[0-9]+\\.[0-9]+') THEN 'scale' ELSE 'decimal' END, ORIG_UPB
    FROM damaged WHERE NOT regexp_full_match(ORIG_UPB, '[0-9]+\\.[0-9]{0,2}')
)"""


def _damaged(spark, folder):
    """Raw text columns of the whole panel with faults planted in some loans."""
    state, age = F.col("STATE"), F.col("LOAN_AGE").cast("int")
    raw = split_lines(raw_lines(panel(spark, folder)))
    return raw.withColumns(
        {
            "ACT_PERIOD": F.when(
                (state == "CA") & (age == 4), F.concat(F.lit("13"), F.substring("ACT_PERIOD", 3, 4))
            ).otherwise(F.col("ACT_PERIOD")),
            "DTI": F.when((state == "FL") & (age == 2), F.concat(F.lit("x"), "DTI")).otherwise(F.col("DTI")),
            "ORIG_UPB": F.when((state == "GA") & (age == 3), F.regexp_replace("ORIG_UPB", r"\.00$", ".125"))
            .when((state == "IL") & (age == 3), F.lit("NaN"))
            .otherwise(F.col("ORIG_UPB")),
        }
    )


@query(
    "chk1_record_violations",
    f"WITH {PANEL}{_DAMAGED} SELECT * FROM broken",
)
def chk1_record_violations(spark, folder):
    """Every broken value of every raw line, with its row, column and rule."""
    return violations(_damaged(spark, folder), fields_of_width(DEFAULT_WIDTH))


@query(
    "chk2_4_rule_counts",
    f"WITH {PANEL}{_DAMAGED} SELECT column_name, rule, count(*) AS rows FROM broken GROUP BY 1, 2",
)
def chk2_4_rule_counts(spark, folder):
    found = violations(_damaged(spark, folder), fields_of_width(DEFAULT_WIDTH))
    return found.groupBy("column_name", "rule").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "chk5_text_lengths",
    """SELECT * FROM (
      SELECT 'text' AS column_name, 1000 AS declared_length, CAST(max(length(text)) AS INT) AS longest,
        count(*) FILTER (length(text) > 1000) AS rows_over FROM documents
      UNION ALL SELECT 'source', 6, CAST(max(length(source)) AS INT), count(*) FILTER (length(source) > 6) FROM documents
      UNION ALL SELECT 'lang', 2, CAST(max(length(lang)) AS INT), count(*) FILTER (length(lang) > 2) FROM documents)
    WHERE rows_over > 0""",
)
def chk5_text_lengths(spark, folder):
    """Over-long text, over the whole texts of the documents table."""
    return text_length_report(
        table(spark, folder, "documents"), {"text": 1000, "source": 6, "lang": 2}
    )


@query(
    "chk7_digit_widths",
    """SELECT 'o_totalprice' AS column_name, 5 AS declared_digits,
      CAST(max(length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR))) AS INT) AS most_digits,
      count(*) FILTER (length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) > 5) AS rows_over FROM orders
    UNION ALL SELECT 'o_custkey', 3, CAST(max(length(CAST(o_custkey AS VARCHAR))) AS INT),
      count(*) FILTER (length(CAST(o_custkey AS VARCHAR)) > 3) FROM orders""",
)
def chk7_digit_widths(spark, folder):
    """Integer digits of numeric columns beside a declared width; an observation only."""
    orders = table(spark, folder, "orders").withColumn(
        "o_totalprice", F.col("o_totalprice").cast("decimal(20,4)")
    )
    return digit_report(orders, {"o_totalprice": 5, "o_custkey": 3})


# Silver.


@query(
    "prj1_typed_columns",
    with_panel(
        """SELECT LOAN_ID, ACT_PERIOD, ORIG_DATE, OLTV, OCLTV, DTI, CSCORE_B, CSCORE_C,
        ORIG_RATE, ORIG_UPB, ORIG_TERM FROM panel"""
    ),
)
def prj1_typed_columns(spark, folder):
    typed = type_columns(split_lines(raw_lines(panel(spark, folder))).replace("", None))
    return typed.select(
        "LOAN_ID", "ACT_PERIOD", "ORIG_DATE", "OLTV", "OCLTV", "DTI", "CSCORE_B", "CSCORE_C",
        F.col("ORIG_RATE").cast("double").alias("ORIG_RATE"),
        F.col("ORIG_UPB").cast("double").alias("ORIG_UPB"),
        "ORIG_TERM",
    )


@query(
    "prj2_code_labels",
    with_panel(
        """SELECT
        CASE CHANNEL WHEN 'B' THEN 'Broker' WHEN 'C' THEN 'Correspondent' WHEN 'R' THEN 'Retail'
          ELSE 'Unmapped (' || CHANNEL || ')' END AS CHANNEL_LABEL,
        CASE PURPOSE WHEN 'C' THEN 'Cash-out refinance' WHEN 'P' THEN 'Purchase' WHEN 'R' THEN 'Rate-term refinance'
          WHEN 'U' THEN 'Unknown' END AS PURPOSE_LABEL,
        CASE PROP WHEN 'CO' THEN 'Condominium' WHEN 'CP' THEN 'Cooperative' WHEN 'MH' THEN 'Manufactured housing'
          WHEN 'PU' THEN 'Planned unit development' WHEN 'SF' THEN 'Single-family' END AS PROP_LABEL,
        CASE OCC_STAT WHEN 'I' THEN 'Investment' WHEN 'P' THEN 'Primary residence' WHEN 'S' THEN 'Second home'
          WHEN 'U' THEN 'Unknown' END AS OCC_STAT_LABEL,
        CASE ZERO_BAL_CODE WHEN '01' THEN 'Prepaid or matured' WHEN '06' THEN 'Repurchased' END AS ZERO_BAL_CODE_LABEL,
        CASE DLQ_STATUS WHEN '00' THEN 'Current' WHEN '01' THEN '30 days delinquent' WHEN '02' THEN '60 days delinquent'
          WHEN '03' THEN '90 days delinquent' WHEN 'XX' THEN 'Unknown' END AS DLQ_STATUS_LABEL,
        count(*) AS rows FROM panel GROUP BY ALL"""
    ),
)
def prj2_code_labels(spark, folder):
    labels = [f"{c}_LABEL" for c in ("CHANNEL", "PURPOSE", "PROP", "OCC_STAT", "ZERO_BAL_CODE", "DLQ_STATUS")]
    return label_codes(panel(spark, folder)).groupBy(*labels).agg(F.count(F.lit(1)).alias("rows"))


_MONTHLY_ORDERS = """SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_orderpriority, o_orderkey,
    o_orderdate FROM orders"""


@query(
    "win1_latest_version",
    f"""SELECT o_custkey, m, o_orderkey, o_orderpriority FROM ({_MONTHLY_ORDERS})
    QUALIFY row_number() OVER (PARTITION BY o_custkey, m ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def win1_latest_version(spark, folder):
    """Newest order of every customer and month."""
    return keep_latest(_monthly_orders(spark, folder), ("o_custkey", "m"), ("o_orderdate", "o_orderkey")).select(
        "o_custkey", "m", "o_orderkey", "o_orderpriority"
    )


def _monthly_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("m"), "o_orderpriority",
        "o_orderkey", "o_orderdate",
    )


@query(
    "win1_silver_dedupe",
    with_panel(
        """SELECT LOAN_ID, ACT_PERIOD, CASE WHEN LOAN_AGE % 5 = 0 THEN 'Second' ELSE 'First' END AS SELLER,
        CASE DLQ_STATUS WHEN '00' THEN 'Current' WHEN '01' THEN '30 days delinquent' WHEN '02' THEN '60 days delinquent'
          WHEN '03' THEN '90 days delinquent' WHEN 'XX' THEN 'Unknown' END AS DLQ_STATUS_LABEL, OLTV FROM panel"""
    ),
)
def win1_silver_dedupe(spark, folder):
    """Raw rows delivered twice, a later delivery correcting some months: the later one is kept."""
    rows = panel(spark, folder)

    def delivery(rows, seller, day):
        return split_lines(raw_lines(rows)).drop("FIELD_COUNT").withColumns(
            {
                "SELLER": F.lit(seller),
                "_ingested_at": F.lit(day).cast("timestamp"),
                "_source_sha256": F.sha2(F.lit(seller), 256),
            }
        )

    # The corrected months are chosen before they become text.
    later = rows.where(F.col("LOAN_AGE") % 5 == 0)
    bronze = delivery(rows, "First", datetime(2026, 1, 1)).unionByName(
        delivery(later, "Second", datetime(2026, 2, 1))
    )
    return silver_table(bronze.replace("", None)).select(
        "LOAN_ID", "ACT_PERIOD", "SELLER", "DLQ_STATUS_LABEL", "OLTV"
    )


@query(
    "win3_spell_numbers",
    with_panel(
        """SELECT LOAN_ID, ACT_PERIOD, SERVICER, c AS NEW_SPELL,
        CAST(sum(c) OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD) AS BIGINT) AS SPELL_NUMBER
        FROM (SELECT *, CASE WHEN lag(SERVICER) OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD) IS DISTINCT FROM SERVICER
          THEN 1 ELSE 0 END AS c FROM panel)"""
    ),
)
def win3_spell_numbers(spark, folder):
    return numbered_spells(panel(spark, folder))


_SPELLS = """WITH s AS (SELECT * FROM (SELECT {k} AS k, {m} AS m, {v} AS v,
      lag({v}) OVER (PARTITION BY {k} ORDER BY {m}) AS b FROM {t}) WHERE b IS DISTINCT FROM v),
    n AS (SELECT *, lead(m) OVER (PARTITION BY k ORDER BY m) AS nx FROM s)
    SELECT sha256(k || '|' || v || '|' || strftime(m, '%Y-%m-%d')) AS LOAN_SERVICER_KEY, k AS LOAN_ID, v AS SERVICER,
      m AS EFFECTIVE_FROM, CAST(nx - to_months(1) AS DATE) AS EFFECTIVE_TO, nx IS NULL AS IS_CURRENT FROM n"""


@query(
    "win4_servicer_spells",
    f"WITH {PANEL}, " + _SPELLS.format(k="LOAN_ID", m="ACT_PERIOD", v="SERVICER", t="panel").replace("WITH ", "", 1),
)
def win4_servicer_spells(spark, folder):
    return servicer_spells(panel(spark, folder))


@query(
    "win4_order_priority_spells",
    "WITH om AS (SELECT 'C' || o_custkey AS c, m, o_orderpriority AS p FROM ("
    + _MONTHLY_ORDERS
    + ") QUALIFY row_number() OVER (PARTITION BY o_custkey, m ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), "
    + _SPELLS.format(k="c", m="m", v="p", t="om").replace("WITH ", "", 1),
)
def win4_order_priority_spells(spark, folder):
    """Spells of a customer's order priority, over one row per customer and month."""
    monthly = keep_latest(_monthly_orders(spark, folder), ("o_custkey", "m"), ("o_orderdate", "o_orderkey"))
    return servicer_spells(
        monthly.select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("LOAN_ID"),
            F.col("m").alias("ACT_PERIOD"),
            F.col("o_orderpriority").alias("SERVICER"),
        )
    )


# Quality gate.


@query(
    "q1_9_quality_report",
    """WITH t AS (SELECT 'O' || o_orderkey AS LOAN_ID, CAST(date_trunc('month', o_orderdate) AS DATE) AS ACT_PERIOD,
      o_orderstatus AS _source_file, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS _source_sha256,
      o_totalprice AS ORIG_UPB, c_acctbal AS CURRENT_UPB,
      CASE WHEN c_mktsegment LIKE 'B%' THEN '0' WHEN c_mktsegment LIKE 'A%' THEN 'XX' WHEN c_mktsegment LIKE 'M%' THEN NULL ELSE '07' END AS DLQ_STATUS
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    u AS (SELECT count(*) AS n FROM t GROUP BY LOAN_ID, ACT_PERIOD HAVING count(*) > 1),
    r(expectation, column_name, observed_rows, unexpected_rows) AS (
      SELECT 'row_count', CAST(NULL AS VARCHAR), count(*), CASE WHEN count(*) < 1 THEN 1 ELSE 0 END FROM t
      UNION ALL SELECT 'not_null', 'LOAN_ID', count(*), count(*) FILTER (LOAN_ID IS NULL) FROM t
      UNION ALL SELECT 'not_null', 'ACT_PERIOD', count(*), count(*) FILTER (ACT_PERIOD IS NULL) FROM t
      UNION ALL SELECT 'not_null', '_source_file', count(*), count(*) FILTER (_source_file IS NULL) FROM t
      UNION ALL SELECT 'not_null', '_source_sha256', count(*), count(*) FILTER (_source_sha256 IS NULL) FROM t
      UNION ALL SELECT 'above_zero', 'ORIG_UPB', count(*), count(*) FILTER (ORIG_UPB <= 0) FROM t
      UNION ALL SELECT 'at_least_zero', 'CURRENT_UPB', count(*), count(*) FILTER (CURRENT_UPB < 0) FROM t
      UNION ALL SELECT 'in_domain', 'DLQ_STATUS', count(*), count(*) FILTER (NOT regexp_full_match(DLQ_STATUS, '[0-9]{2}|XX')) FROM t
      UNION ALL SELECT 'unique_key', 'LOAN_ID,ACT_PERIOD', NULL, coalesce((SELECT sum(n) FROM u), 0))
    SELECT expectation, column_name, observed_rows, CAST(unexpected_rows AS BIGINT) AS unexpected_rows,
      CASE WHEN unexpected_rows > 0 THEN 'failed' ELSE 'passed' END AS status FROM r""",
)
def q1_9_quality_report(spark, folder):
    """The gate over orders read as loan-months: some rules pass, some fail."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    segment = F.col("c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("LOAN_ID"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("ACT_PERIOD"),
        F.col("o_orderstatus").alias("_source_file"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("_source_sha256"),
        F.col("o_totalprice").alias("ORIG_UPB"),
        F.col("c_acctbal").alias("CURRENT_UPB"),
        F.when(segment.startswith("B"), "0")
        .when(segment.startswith("A"), "XX")
        .when(~segment.startswith("M"), "07")
        .alias("DLQ_STATUS"),
    )
    return quality_report(rows)


@query(
    "q6_repeated_keys",
    """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS unexpected_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def q6_repeated_keys(spark, folder):
    return repeated_key_rows(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


# Acquisition summary.


@query(
    "win8_latest_per_loan",
    with_panel(
        "SELECT LOAN_ID, ACT_PERIOD, DLQ_STATUS, SERVICER FROM panel QUALIFY row_number() OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD DESC) = 1"
    ),
)
def win8_latest_per_loan(spark, folder):
    return latest_per_loan(panel(spark, folder)).select("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS", "SERVICER")


_SUMMARY = """summary AS (
  SELECT coalesce(y, 'Total') AS ORIGINATION_YEAR, count(*) AS LOAN_COUNT, sum(ORIG_UPB) / 1e6 AS TOTAL_ORIGINAL_UPB_MILLIONS,
    avg(ORIG_UPB) AS AVERAGE_ORIGINAL_UPB,
    sum(f * ORIG_UPB) / sum(CASE WHEN f IS NOT NULL THEN ORIG_UPB END) AS CLASSIC_FICO,
    sum(OLTV * ORIG_UPB) / sum(ORIG_UPB) AS OLTV, sum(coalesce(OCLTV, OLTV) * ORIG_UPB) / sum(ORIG_UPB) AS OCLTV,
    sum(DTI * ORIG_UPB) / sum(ORIG_UPB) AS DTI, sum(ORIG_RATE * ORIG_UPB) / sum(ORIG_UPB) AS NOTE_RATE
  FROM (SELECT *, strftime(ORIG_DATE, '%Y') AS y, least(CSCORE_B, CSCORE_C) AS f FROM panel
        QUALIFY row_number() OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD DESC) = 1)
  GROUP BY GROUPING SETS ((y), ())
)"""
_SUMMARY_OUT = ", ".join(f"round({m}, 6) AS {m}" if m != "LOAN_COUNT" else m for m in METRICS)


@query("agg1_acquisition_summary", f"WITH {PANEL}, {_SUMMARY} SELECT ORIGINATION_YEAR, {_SUMMARY_OUT} FROM summary")
def agg1_acquisition_summary(spark, folder):
    return rounded(acquisition_summary(panel(spark, folder)))


@query(
    "agg2_weighted_average",
    """SELECT CAST(year(l_shipdate) AS INT) AS ship_year,
    round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS mean_discount, count(*) AS rows
    FROM lineitem GROUP BY 1""",
)
def agg2_weighted_average(spark, folder):
    items = table(spark, folder, "lineitem")
    return rounded(
        items.groupBy(F.year("l_shipdate").alias("ship_year")).agg(
            weighted_mean(F.col("l_discount"), F.col("l_extendedprice")).alias("mean_discount"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


@query(
    "agg4_observed_quarters",
    with_panel("SELECT DISTINCT _source_file[1:6] AS quarter FROM panel"),
)
def agg4_observed_quarters(spark, folder):
    return observed_quarters(panel(spark, folder))


_QUARTER_LIST = ", ".join(f"('{q}')" for q in PUBLISHED_QUARTERS)


@query(
    "agg5_population_differences",
    with_panel(
        f""", o AS (SELECT DISTINCT _source_file[1:6] AS quarter FROM panel), e(quarter) AS (VALUES {_QUARTER_LIST})
        SELECT quarter, 'missing' AS problem FROM (SELECT quarter FROM e EXCEPT SELECT quarter FROM o)
        UNION ALL SELECT quarter, 'extra' FROM (SELECT quarter FROM o EXCEPT SELECT quarter FROM e)"""
    ).replace("\n,", ",", 1),
)
def agg5_population_differences(spark, folder):
    observed = observed_quarters(panel(spark, folder))
    return population_differences(observed, quarter_frame(spark, PUBLISHED_QUARTERS))


def _published_values() -> str:
    rows = []
    for year, *values in PUBLISHED_ROWS:
        rows.append("('" + year + "', " + ", ".join(f"{v}::DOUBLE" for v in values) + ")")
    return ", ".join(rows)


_TALL_ACTUAL = " UNION ALL ".join(
    f"SELECT ORIGINATION_YEAR, '{m}' AS metric, CAST({m} AS DOUBLE) AS actual FROM summary" for m in METRICS
)
_TOLERANCE = dict(zip(METRICS, ("0", "0.5", "0.5", "0.5", "0.05", "0.05", "0.05", "0.05")))
_TALL_EXPECTED = " UNION ALL ".join(
    f"SELECT y AS ORIGINATION_YEAR, '{m}' AS metric, v{i} AS expected, {_TOLERANCE[m]}::DOUBLE AS tolerance FROM pub"
    for i, m in enumerate(METRICS)
)


@query(
    "jn7_published_differences",
    f"""WITH {PANEL}, {_SUMMARY}, pub(y, {", ".join(f"v{i}" for i in range(len(METRICS)))}) AS (VALUES {_published_values()}),
    e AS ({_TALL_EXPECTED}), a AS ({_TALL_ACTUAL})
    SELECT ORIGINATION_YEAR, metric, expected, round(actual, 6) AS actual, tolerance FROM e LEFT JOIN a USING (ORIGINATION_YEAR, metric)
    WHERE actual IS NULL OR abs(actual - expected) > tolerance""",
)
def jn7_published_differences(spark, folder):
    """Cells of the published table that the panel's summary does not reproduce within tolerance."""
    return rounded(summary_differences(acquisition_summary(panel(spark, folder)), published_table(spark)))
