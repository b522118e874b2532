"""Survival framing, splits, features, as-of joins and panel checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vintageline.functions.columns import months_delinquent
from vintageline.operators.asof import (
    as_of_dates,
    coverage,
    join_releases,
    latest_releases,
    lookahead_rows,
    release_violations,
    wide_releases,
)
from vintageline.operators.features import loan_features
from vintageline.operators.gold import reconciliation_counts, row_count_mismatches
from vintageline.operators.splits import assign_splits, straddling_loans, unparsed_sources
from vintageline.operators.survival import loan_facts, survival_panel
from vintageline.plans.incremental import merge_silver, read_gold, refresh_gold
from vintageline.queries.inputs import gold, panel, query, releases, rounded, use_scratch
from vintageline.queries.twins import (
    MACRO_WIDE,
    PANEL,
    RELEASES,
    SPLIT_COLUMNS,
    SURVIVAL,
    with_gold,
    with_panel,
    with_split,
    with_survival,
)
from vintageline.settings import HPI_SERIES, MACRO_SERIES
from vintageline.sources.snapshots import publish
from vintageline.sources.synthetic import synthetic_loans, synthetic_outcomes
from vintageline.queries.inputs import table
from vintageline.validation.leakage import changed_cells


@query(
    "survival_by_exit_and_split",
    with_split(
        """SELECT MODELLING_SPLIT, EXIT_TYPE, count(*) AS at_risk_rows, count(DISTINCT LOAN_ID) AS loans,
        CAST(coalesce(sum(DEFAULT_IN_12M),0) AS BIGINT) AS defaults_12m,
        count(DEFAULT_IN_12M) AS known_12m, CAST(coalesce(sum(DEFAULT_NEXT_MONTH),0) AS BIGINT) AS defaults_next,
        count(DEFAULT_NEXT_MONTH) AS known_next FROM splitp GROUP BY 1, 2"""
    ),
)
def survival_by_exit_and_split(spark, folder):
    """Flagship: at-risk months, defaults and known labels per exit type and modelling split."""
    rows = assign_splits(survival_panel(panel(spark, folder)))
    loan_level = rows.groupBy("MODELLING_SPLIT", "EXIT_TYPE", "LOAN_ID").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("DEFAULT_IN_12M").alias("d12"),
        F.count("DEFAULT_IN_12M").alias("k12"),
        F.sum("DEFAULT_NEXT_MONTH").alias("d1"),
        F.count("DEFAULT_NEXT_MONTH").alias("k1"),
    )
    return loan_level.groupBy("MODELLING_SPLIT", "EXIT_TYPE").agg(
        F.sum("n").alias("at_risk_rows"),
        F.count(F.lit(1)).alias("loans"),
        F.coalesce(F.sum("d12"), F.lit(0)).alias("defaults_12m"),
        F.sum("k12").alias("known_12m"),
        F.coalesce(F.sum("d1"), F.lit(0)).alias("defaults_next"),
        F.sum("k1").alias("known_next"),
    )


@query(
    "src11_synthetic_panel",
    with_panel(
        """SELECT LOAN_ID, ACT_PERIOD, ORIG_DATE, CHANNEL, SERVICER, ORIG_RATE, ORIG_UPB,
        round(CURRENT_UPB, 2) AS CURRENT_UPB, OLTV, OCLTV, DTI, CSCORE_B, CSCORE_C, PURPOSE, PROP, OCC_STAT, STATE,
        DLQ_STATUS, ZERO_BAL_CODE, _source_file AS source_file FROM panel"""
    ),
)
def src11_synthetic_panel(spark, folder):
    return panel(spark, folder).select(
        "LOAN_ID", "ACT_PERIOD", "ORIG_DATE", "CHANNEL", "SERVICER",
        F.col("ORIG_RATE").cast("double").alias("ORIG_RATE"),
        F.col("ORIG_UPB").cast("double").alias("ORIG_UPB"),
        F.round("CURRENT_UPB", 2).alias("CURRENT_UPB"),
        "OLTV", "OCLTV", "DTI", "CSCORE_B", "CSCORE_C", "PURPOSE", "PROP", "OCC_STAT", "STATE",
        "DLQ_STATUS", "ZERO_BAL_CODE", F.col("_source_file").alias("source_file"),
    )


@query(
    "src11_synthetic_outcomes",
    f"""WITH {PANEL} SELECT LOAN_ID, quarter AS ACQUISITION_QUARTER,
    CASE ev WHEN 'D' THEN 'default' WHEN 'P' THEN 'prepaid' WHEN 'R' THEN 'repurchased' ELSE 'censored' END AS EVENT_TYPE,
    CASE WHEN ev <> 'C' THEN CAST(em AS INT) END AS EVENT_MONTH, CAST(sc AS INT) AS RISK_SCORE FROM loan""",
)
def src11_synthetic_outcomes(spark, folder):
    return synthetic_outcomes(synthetic_loans(table(spark, folder, "customer")))


_MARKERS = """LOAN_ID, FIRST_CENSOR_DATE, FIRST_CENSOR_CODE, LAST_OBSERVED_DATE, SOURCE_OBSERVED_MONTHS,
    FIRST_D90_DATE, EXIT_DATE, EXIT_TYPE"""


@query("win5_survival_markers", f"WITH {SURVIVAL} SELECT DISTINCT {_MARKERS} FROM exits")
def win5_survival_markers(spark, folder):
    return loan_facts(panel(spark, folder)).drop("_months")


@query(
    "win6_first_censor_code",
    f"""WITH {PANEL} SELECT LOAN_ID, arg_min(ZERO_BAL_CODE, ACT_PERIOD) FILTER (trim(ZERO_BAL_CODE) <> '')
    AS FIRST_CENSOR_CODE FROM panel GROUP BY LOAN_ID""",
)
def win6_first_censor_code(spark, folder):
    return loan_facts(panel(spark, folder)).select("LOAN_ID", "FIRST_CENSOR_CODE")


@query(
    "win7_at_risk_months",
    with_survival("SELECT LOAN_ID, ACT_PERIOD, AT_RISK_OBSERVED_MONTHS, AT_RISK_MONTH_NUMBER FROM surv"),
)
def win7_at_risk_months(spark, folder):
    return survival_panel(panel(spark, folder)).select(
        "LOAN_ID", "ACT_PERIOD", "AT_RISK_OBSERVED_MONTHS", "AT_RISK_MONTH_NUMBER"
    )


@query(
    "srv1_exit_types",
    f"""WITH {SURVIVAL} SELECT EXIT_TYPE, count(*) AS loans, min(EXIT_DATE) AS first_exit, max(EXIT_DATE) AS last_exit
    FROM (SELECT DISTINCT LOAN_ID, EXIT_TYPE, EXIT_DATE FROM exits) GROUP BY 1""",
)
def srv1_exit_types(spark, folder):
    return loan_facts(panel(spark, folder)).groupBy("EXIT_TYPE").agg(
        F.count(F.lit(1)).alias("loans"),
        F.min("EXIT_DATE").alias("first_exit"),
        F.max("EXIT_DATE").alias("last_exit"),
    )


@query(
    "srv2_at_risk_rows",
    with_survival("SELECT ACT_PERIOD, count(*) AS at_risk_rows FROM surv GROUP BY 1"),
)
def srv2_at_risk_rows(spark, folder):
    return survival_panel(panel(spark, folder)).groupBy("ACT_PERIOD").agg(
        F.count(F.lit(1)).alias("at_risk_rows")
    )


@query(
    "srv3_default_in_12m",
    with_survival(
        """SELECT LOAN_ID, ACT_PERIOD, HORIZON_END_DATE, DEFAULT_IN_12M, DEFAULT_IN_12M IS NOT NULL AS LABEL_OBSERVED_12M
        FROM surv"""
    ),
)
def srv3_default_in_12m(spark, folder):
    return survival_panel(panel(spark, folder)).select(
        "LOAN_ID", "ACT_PERIOD", "HORIZON_END_DATE", "DEFAULT_IN_12M", "LABEL_OBSERVED_12M"
    )


@query(
    "srv4_default_next_month",
    with_survival("SELECT LOAN_ID, ACT_PERIOD, DEFAULT_NEXT_MONTH FROM surv"),
)
def srv4_default_next_month(spark, folder):
    return survival_panel(panel(spark, folder)).select("LOAN_ID", "ACT_PERIOD", "DEFAULT_NEXT_MONTH")


_SURVIVAL_OUT = [
    "LOAN_ID", "ACT_PERIOD", "DLQ_STATUS", "FIRST_CENSOR_DATE", "FIRST_CENSOR_CODE", "LAST_OBSERVED_DATE",
    "SOURCE_OBSERVED_MONTHS", "FIRST_D90_DATE", "EXIT_DATE", "EXIT_TYPE", "HORIZON_END_DATE",
    "DEFAULT_NEXT_MONTH", "DEFAULT_IN_12M", "AT_RISK_OBSERVED_MONTHS", "AT_RISK_MONTH_NUMBER",
]


@query("srv5_survival_panel", with_survival(f"SELECT {', '.join(_SURVIVAL_OUT)} FROM surv"))
def srv5_survival_panel(spark, folder):
    return survival_panel(panel(spark, folder)).select(*_SURVIVAL_OUT)


_GOLD_DOUBLES = [
    "ORIGINAL_PROPERTY_VALUE", "CURRENT_LTV_UNINDEXED", "ESTIMATED_CURRENT_PROPERTY_VALUE", "CURRENT_LTV",
]
_GOLD_MACRO = [f"{s}{x}" for s in (*MACRO_SERIES, f"ORIG_{HPI_SERIES}") for x in ("", "_OBSERVATION_DATE", "_AVAILABLE_DATE")]
_GOLD_OUT = [
    "LOAN_ID", "ACT_PERIOD", "EXIT_TYPE", "DEFAULT_NEXT_MONTH", "DEFAULT_IN_12M", "SEASONING_MONTHS", "CLASSIC_FICO",
    "ACQUISITION_QUARTER", "TEMPORAL_SPLIT", "IS_OUT_OF_VINTAGE", "MODELLING_SPLIT",
]


_GOLD_TWIN = with_gold(
    "SELECT "
    + ", ".join(_GOLD_OUT + [f"round({c}, 6) AS {c}" for c in _GOLD_DOUBLES])
    + ", "
    + ", ".join(c if "DATE" in c else f"CAST({c} AS DOUBLE) AS {c}" for c in _GOLD_MACRO)
    + " FROM gold"
)


def _gold_out(rows):
    return rows.select(
        *_GOLD_OUT,
        *(F.round(c, 6).alias(c) for c in _GOLD_DOUBLES),
        *(c if "DATE" in c else F.col(c).cast("double").alias(c) for c in _GOLD_MACRO),
    )


@query("srv6_gold_panel", _GOLD_TWIN)
def srv6_gold_panel(spark, folder):
    return _gold_out(gold(spark, folder))


@query("x16_incremental_gold", _GOLD_TWIN)
def x16_incremental_gold(spark, folder):
    """Gold kept up to date over two deliveries equals a full build.

    The first delivery ends in 2012, before some releases were known, and reports a third of the loans as current;
    the second brings their corrections, all later months and the whole archive of releases.
    """
    rows, known = panel(spark, folder), releases(spark)
    base = use_scratch(spark)
    silver, macro, target = (f"{base}/{name}" for name in ("silver", "macro", "gold"))
    early = F.col("ACT_PERIOD") <= F.lit(date(2012, 12, 1))
    wrong = F.substring("LOAN_ID", -1, 1).isin("1", "4", "7")
    first = rows.where(early).withColumn("DLQ_STATUS", F.when(wrong, "00").otherwise(F.col("DLQ_STATUS")))
    merge_silver(first, silver, slots=8)
    publish(known.where(F.col("AVAILABLE_DATE") <= F.lit(date(2013, 6, 1))), macro)
    refresh_gold(spark, silver, macro, target)
    merge_silver(rows.where(~early | wrong), silver, slots=8)
    publish(known, macro)
    refresh_gold(spark, silver, macro, target)
    return _gold_out(read_gold(spark, target))


@query(
    "prj3_numeric_delinquency",
    with_panel(
        """SELECT DLQ_STATUS, CASE WHEN regexp_full_match(DLQ_STATUS, '[0-9]+') THEN TRY_CAST(DLQ_STATUS AS INT) END
        AS months_late, count(*) AS rows FROM panel GROUP BY 1, 2"""
    ),
)
def prj3_numeric_delinquency(spark, folder):
    late = months_delinquent(F.col("DLQ_STATUS")).alias("months_late")
    return panel(spark, folder).groupBy("DLQ_STATUS", late).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "prj4_loan_features",
    with_panel(
        """SELECT LOAN_ID, ACT_PERIOD,
        CAST((year(ACT_PERIOD)-year(ORIG_DATE))*12 + month(ACT_PERIOD)-month(ORIG_DATE) AS INT) AS SEASONING_MONTHS,
        least(CSCORE_B, CSCORE_C) AS CLASSIC_FICO,
        round(ORIG_UPB / (OLTV / 100.0::DOUBLE), 6) AS ORIGINAL_PROPERTY_VALUE,
        round(CURRENT_UPB / (ORIG_UPB / (OLTV / 100.0::DOUBLE)) * 100.0::DOUBLE, 6) AS CURRENT_LTV_UNINDEXED FROM panel"""
    ),
)
def prj4_loan_features(spark, folder):
    return rounded(
        loan_features(panel(spark, folder)).select(
            "LOAN_ID", "ACT_PERIOD", "SEASONING_MONTHS", "CLASSIC_FICO", "ORIGINAL_PROPERTY_VALUE",
            "CURRENT_LTV_UNINDEXED",
        )
    )


@query(
    "prj5_classic_fico",
    with_panel(
        """SELECT least(CSCORE_B, CSCORE_C) AS CLASSIC_FICO, count(DISTINCT LOAN_ID) AS loans FROM panel GROUP BY 1"""
    ),
)
def prj5_classic_fico(spark, folder):
    rows = loan_features(panel(spark, folder)).select("CLASSIC_FICO", "LOAN_ID").distinct()
    return rows.groupBy("CLASSIC_FICO").agg(F.count(F.lit(1)).alias("loans"))


@query(
    "prj7_indexed_ltv",
    with_gold(
        """SELECT ACQUISITION_QUARTER, ACT_PERIOD, count(CURRENT_LTV) AS indexed_rows,
        round(avg(CURRENT_LTV), 6) AS mean_ltv, round(min(CURRENT_LTV), 6) AS low_ltv, round(max(CURRENT_LTV), 6) AS high_ltv
        FROM gold GROUP BY 1, 2"""
    ),
)
def prj7_indexed_ltv(spark, folder):
    return rounded(
        gold(spark, folder).groupBy("ACQUISITION_QUARTER", "ACT_PERIOD").agg(
            F.count("CURRENT_LTV").alias("indexed_rows"),
            F.avg("CURRENT_LTV").alias("mean_ltv"),
            F.min("CURRENT_LTV").alias("low_ltv"),
            F.max("CURRENT_LTV").alias("high_ltv"),
        )
    )


@query(
    "prj8_source_quarters",
    with_panel(
        f"""SELECT ACQUISITION_QUARTER, count(*) AS rows FROM (SELECT {SPLIT_COLUMNS} FROM panel) GROUP BY 1"""
    ),
)
def prj8_source_quarters(spark, folder):
    return assign_splits(panel(spark, folder)).groupBy("ACQUISITION_QUARTER").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "prj9_model_splits",
    with_split(
        """SELECT TEMPORAL_SPLIT, IS_OUT_OF_VINTAGE, MODELLING_SPLIT, count(*) AS rows, min(ACT_PERIOD) AS first_month,
        max(ACT_PERIOD) AS last_month FROM splitp GROUP BY 1, 2, 3"""
    ),
)
def prj9_model_splits(spark, folder):
    return assign_splits(survival_panel(panel(spark, folder))).groupBy(
        "TEMPORAL_SPLIT", "IS_OUT_OF_VINTAGE", "MODELLING_SPLIT"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ACT_PERIOD").alias("first_month"),
        F.max("ACT_PERIOD").alias("last_month"),
    )


@query(
    "prj9_unparsed_sources",
    "SELECT DISTINCT source AS _source_file FROM documents WHERE source IS NULL OR NOT regexp_full_match(source, '[0-9]{4}[qQ][1-4](\\.csv)?')",
)
def prj9_unparsed_sources(spark, folder):
    """Source names from which no quarter can be read, over the documents' source column."""
    return unparsed_sources(
        table(spark, folder, "documents").select(F.col("source").alias("_source_file"))
    )


_WIDE = ", ".join(
    [f"CAST({s} AS DOUBLE) AS {s}, {s}_OBSERVATION_DATE, {s}_AVAILABLE_DATE" for s in MACRO_SERIES]
)


@query(
    "jn1_asof_macro",
    f"WITH {PANEL}, {RELEASES}, {MACRO_WIDE} SELECT LOAN_ID, ACT_PERIOD, {_WIDE} FROM panel LEFT JOIN wide ON ACT_PERIOD = aod",
)
def jn1_asof_macro(spark, folder):
    rows = panel(spark, folder).select("LOAN_ID", "ACT_PERIOD")
    joined = join_releases(rows, releases(spark))
    return joined.select(
        *(F.col(c).cast("double").alias(c) if c in MACRO_SERIES else c for c in joined.columns)
    )


_LATEST = f"""WITH {PANEL}, {RELEASES}
    SELECT aod AS AOD, SERIES_ID, max(OBSERVATION_DATE) AS OBSERVATION_DATE,
      arg_max(AVAILABLE_DATE, {{'a': OBSERVATION_DATE, 'b': AVAILABLE_DATE}}) AS AVAILABLE_DATE,
      CAST(arg_max(VALUE, {{'a': OBSERVATION_DATE, 'b': AVAILABLE_DATE}}) AS DOUBLE) AS VALUE
    FROM (SELECT DISTINCT ACT_PERIOD AS aod FROM panel) d JOIN releases r
      ON r.OBSERVATION_DATE <= d.aod AND r.AVAILABLE_DATE <= d.aod GROUP BY 1, 2"""


@query("jn2_latest_release", _LATEST)
def jn2_latest_release(spark, folder):
    days = as_of_dates(panel(spark, folder), "ACT_PERIOD")
    return latest_releases(days, releases(spark)).withColumn("VALUE", F.col("VALUE").cast("double"))


@query(
    "jn3_origination_macro",
    f"""WITH {PANEL}, {RELEASES}, {MACRO_WIDE} SELECT LOAN_ID, ACT_PERIOD, CAST(ORIG_CSUSHPINSA AS DOUBLE) AS ORIG_CSUSHPINSA,
    ORIG_CSUSHPINSA_OBSERVATION_DATE, ORIG_CSUSHPINSA_AVAILABLE_DATE FROM panel LEFT JOIN wideo ON ORIG_DATE = aod""",
)
def jn3_origination_macro(spark, folder):
    rows = panel(spark, folder).select("LOAN_ID", "ACT_PERIOD", "ORIG_DATE")
    joined = join_releases(rows, releases(spark), "ORIG_DATE", (HPI_SERIES,), "ORIG_")
    return joined.withColumn("ORIG_CSUSHPINSA", F.col("ORIG_CSUSHPINSA").cast("double")).drop("ORIG_DATE")


@query(
    "jn4_macro_coverage",
    f"""WITH {PANEL}, {RELEASES}, d AS (SELECT DISTINCT ACT_PERIOD AS aod FROM panel),
    m AS (SELECT SERIES_ID, count(DISTINCT aod) AS k FROM d JOIN releases r ON OBSERVATION_DATE <= aod AND AVAILABLE_DATE <= aod
      GROUP BY 1)
    SELECT r.SERIES_ID, count(*) AS releases_held, (SELECT count(*) FROM d) AS dates_asked,
      coalesce(max(k), 0) AS dates_matched FROM releases r LEFT JOIN m USING (SERIES_ID) GROUP BY 1""",
)
def jn4_macro_coverage(spark, folder):
    return coverage(panel(spark, folder), releases(spark))


@query(
    "agg7_wide_releases",
    f"WITH {PANEL}, {RELEASES}, {MACRO_WIDE} SELECT aod AS AOD, {_WIDE} FROM wide",
)
def agg7_wide_releases(spark, folder):
    days = as_of_dates(panel(spark, folder), "ACT_PERIOD")
    wide = wide_releases(latest_releases(days, releases(spark)), MACRO_SERIES)
    return wide.select(*(F.col(c).cast("double").alias(c) if c in MACRO_SERIES else c for c in wide.columns))


_ORDER_RELEASES = """SELECT CASE o_orderstatus WHEN 'F' THEN 'UNRATE' WHEN 'O' THEN 'CSUSHPINSA' ELSE o_orderstatus END AS s,
    CAST(o_orderdate AS DATE) AS d FROM orders"""


@query(
    "q10_release_rules",
    f"""WITH r AS ({_ORDER_RELEASES}), v AS (SELECT s, d, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT 'null_value' AS rule, CAST((SELECT count(*) FROM r WHERE s IS NULL OR d IS NULL) AS BIGINT) AS violations
    UNION ALL SELECT 'unknown_series', CAST(coalesce((SELECT sum(n) FROM v WHERE s NOT IN ('UNRATE','CSUSHPINSA','MORTGAGE30US')), 0) AS BIGINT)
    UNION ALL SELECT 'duplicate_vintage', CAST(coalesce((SELECT sum(n) FROM v WHERE n > 1), 0) AS BIGINT)""",
)
def q10_release_rules(spark, folder):
    """Release rules over orders read as a release table: status as series, order day as both dates."""
    day = F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    series = F.when(status == "F", "UNRATE").when(status == "O", "CSUSHPINSA").otherwise(status)
    return release_violations(
        table(spark, folder, "orders").select(
            series.alias("SERIES_ID"), day.alias("OBSERVATION_DATE"), day.alias("AVAILABLE_DATE"),
            F.col("o_totalprice").alias("VALUE"),
        )
    )


@query(
    "jn5_reconciliation",
    with_survival(
        """, g AS (SELECT LOAN_ID, count(*) AS n FROM surv WHERE NOT (STATE = 'CA' AND AT_RISK_MONTH_NUMBER = 3) GROUP BY 1),
        e AS (SELECT LOAN_ID, count(*) AS n FROM surv GROUP BY 1)
        SELECT LOAN_ID, coalesce(e.n, -1) AS EXPECTED_ROWS, coalesce(g.n, -1) AS ACTUAL_ROWS
        FROM e FULL JOIN g USING (LOAN_ID) WHERE coalesce(e.n, -1) <> coalesce(g.n, -1)"""
    ).replace("\n,", ",", 1),
)
def jn5_reconciliation(spark, folder):
    """Per-loan differences after one month of some loans is withheld from the panel."""
    silver = panel(spark, folder)
    withheld = (F.col("STATE") == "CA") & (F.col("AT_RISK_MONTH_NUMBER") == 3)
    return row_count_mismatches(silver, survival_panel(silver).where(~withheld))


@query(
    "agg8_reconciliation_counts",
    with_survival(
        """SELECT (SELECT count(DISTINCT LOAN_ID) FROM surv) AS loan_count, (SELECT count(*) FROM panel) AS silver_rows,
        (SELECT count(*) FROM surv) AS gold_rows, (SELECT count(*) FROM panel) - (SELECT count(*) FROM surv) AS excluded_rows"""
    ),
)
def agg8_reconciliation_counts(spark, folder):
    silver = panel(spark, folder)
    return reconciliation_counts(silver, survival_panel(silver))


@query(
    "jn6_split_integrity",
    with_split(
        """, merged AS (SELECT CASE WHEN STATE='TX' THEN 'L' || CAST(OLTV AS VARCHAR) ELSE LOAN_ID END AS LOAN_ID,
        MODELLING_SPLIT FROM splitp)
        SELECT LOAN_ID FROM merged GROUP BY 1
        HAVING bool_or(MODELLING_SPLIT='train') AND bool_or(MODELLING_SPLIT='out_of_vintage')"""
    ).replace("\n,", ",", 1),
)
def jn6_split_integrity(spark, folder):
    """Loans on both sides of the split, once some loans are made to share an identifier."""
    shared = F.when(
        F.col("STATE") == "TX", F.concat(F.lit("L"), F.col("OLTV").cast("string"))
    ).otherwise(F.col("LOAN_ID"))
    rows = assign_splits(survival_panel(panel(spark, folder)))
    return straddling_loans(rows.withColumn("LOAN_ID", shared))


@query(
    "val7_macro_lookahead",
    with_gold(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{s}_{x}' AS column_name, count(*) FILTER ({s}_{x} > {d}) AS late_rows FROM gold"
            for s, d in [(m, "ACT_PERIOD") for m in MACRO_SERIES] + [("ORIG_CSUSHPINSA", "ORIG_DATE")]
            for x in ("OBSERVATION_DATE", "AVAILABLE_DATE")
        )
        + ")"
    ),
)
def val7_macro_lookahead(spark, folder):
    return lookahead_rows(
        gold(spark, folder), {"ACT_PERIOD": MACRO_SERIES, "ORIG_DATE": (f"ORIG_{HPI_SERIES}",)}
    )


_CHANGED = [c for c in _SURVIVAL_OUT if c not in ("LOAN_ID", "ACT_PERIOD")]


def _leakage_twin() -> str:
    tail = SURVIVAL[len(PANEL):]
    late = tail
    early = tail
    for name in ("marked", "resolved", "exits", "surv"):
        early = early.replace(f"{name} AS (", f"{name}_e AS (").replace(f"FROM {name}", f"FROM {name}_e")
    early = early.replace("FROM panel\n", "FROM panel_e\n")
    cells = " UNION ALL ".join(
        f"SELECT (SELECT count(*) FROM pairs) AS rows_compared, '{c}' AS column_name, "
        f"(SELECT count(*) FROM pairs WHERE f_{c} IS DISTINCT FROM e_{c}) AS changed_rows"
        for c in _CHANGED
    )
    columns = ", ".join(f"f.{c} AS f_{c}, e.{c} AS e_{c}" for c in _CHANGED)
    return (
        f"WITH {PANEL}, panel_e AS (SELECT * FROM panel WHERE ACT_PERIOD <= DATE '2013-06-01'){late}{early}, "
        f"pairs AS (SELECT {columns} FROM surv f JOIN surv_e e USING (LOAN_ID, ACT_PERIOD) "
        f"WHERE ACT_PERIOD <= DATE '2013-06-01') SELECT * FROM ({cells})"
    )


@query("val6_temporal_invariance", _leakage_twin())
def val6_temporal_invariance(spark, folder):
    """Cells of the survival panel that change once the months after a cutoff are withheld."""
    return changed_cells(
        lambda rows: survival_panel(rows).select(*_SURVIVAL_OUT), panel(spark, folder), date(2013, 6, 1)
    )
