"""Deterministic loan-month panels seeded from integer keys (SRC11).

Each key becomes one loan whose attributes, outcome and life are integer functions of the key, so
the panel grows with the seed table, needs no random state, and is the same on every executor.
``synthetic_loans`` holds the ground truth; ``synthetic_panel`` unfolds the months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.sources.contract import DEFAULT_WIDTH, DELIMITER, fields_of_width

# Fixed values of the fixture.
QUARTERS = ("2005Q1", "2005Q3", "2007Q1", "2012Q1", "2016Q1", "2018Q1")
STATES = ("CA", "FL", "GA", "IL", "NY", "OH", "TX", "WA")
CHANNELS = ("R", "C", "B")
PURPOSES = ("P", "R", "C", "U")
PROPERTIES = ("SF", "CO", "PU", "CP", "MH")
OCCUPANCIES = ("P", "S", "I", "U")
EVENTS = {"D": "default", "P": "prepaid", "R": "repurchased", "C": "censored"}


def _pick(values: tuple, index: str) -> str:
    """SQL for the value at a 0-based position of a fixed list."""
    listed = ", ".join(repr(v) for v in values)
    return f"element_at(array({listed}), int({index}) + 1)"


def synthetic_loans(seeds: DataFrame, key: str = "c_custkey") -> DataFrame:
    """One row per seed key: contract attributes plus the known outcome of the loan.

    Keys are spread over the session's partitions before they unfold into months, because a seed file
    that fits one task holds far more loan-months than it holds rows. Only the key moves.
    """
    partitions = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = seeds.where(F.col(key).isNotNull()).select(key).repartition(partitions, key)
    drawn = spread.selectExpr(
        f"bigint({key}) AS k",
        f"bigint({key}) % 6 AS q",
        f"55 + ({key} * 37) % 43 AS ltv",
        f"18 + ({key} * 53) % 33 AS dti",
        f"610 + ({key} * 71) % 201 AS score",
        f"({key} * 13) % 100 AS draw",
    )
    risk = "16 * (ltv - 55) + 16 * (dti - 18) + 3 * (810 - score) + IF(q < 3, 700, 300)"
    judged = drawn.selectExpr(
        "*",
        f"{risk} AS risk",
        f"{_pick(QUARTERS, 'q')} AS quarter",
        f"""CASE WHEN k % 29 = 0 THEN 'R' WHEN {risk} > 1240 AND draw < 75 THEN 'D'
            WHEN {risk} < 520 AND draw < 70 THEN 'P' ELSE 'C' END AS event""",
        "13 + (k * 19) % IF(q = 3, 80, 20) AS event_month",
        "IF(q = 3, 96, 36) AS longest",
    )
    first_month = "make_date(int(substr(quarter, 1, 4)), int(substr(quarter, 6, 1)) * 3 - 2, 1)"
    return judged.selectExpr(
        "k AS KEY",
        "concat('SYN', lpad(string(k), greatest(9, length(string(k))), '0')) AS LOAN_ID",
        "concat(quarter, '.csv') AS _source_file",
        f"{first_month} AS FIRST_MONTH",
        f"add_months({first_month}, -2) AS ORIG_DATE",
        "int(ltv) AS OLTV",
        f"IF(k % 11 = 0, NULL, int(least(105, ltv + {_pick((0, 0, 5, 10), 'k % 4')}))) AS OCLTV",
        "int(dti) AS DTI",
        "int(score) AS CSCORE_B",
        "IF(k % 2 = 0, NULL, int(620 + (k * 29) % 201)) AS CSCORE_C",
        "cast(80000 + 5000 * ((k * 17) % 114) AS decimal(20,2)) AS ORIG_UPB",
        f"{_pick((180, 240, 360), 'k % 3')} AS ORIG_TERM",
        "cast((2750 + (k * 97) % 4501) / 1000 AS decimal(20,3)) AS ORIG_RATE",
        f"IF(k % 101 = 0, 'Z', {_pick(CHANNELS, 'k % 3')}) AS CHANNEL",
        f"{_pick(PURPOSES, 'k % 4')} AS PURPOSE",
        f"{_pick(PROPERTIES, 'k % 5')} AS PROP",
        f"{_pick(OCCUPANCIES, '(k div 2) % 4')} AS OCC_STAT",
        f"{_pick(STATES, 'k % 8')} AS STATE",
        "int(risk) AS RISK_SCORE",
        "event AS EVENT",
        "IF(event = 'C', NULL, int(event_month)) AS EVENT_MONTH",
        """int(CASE event WHEN 'D' THEN least(longest, event_month + 3) WHEN 'C' THEN longest
            ELSE least(longest, event_month) END) AS MONTHS""",
    )


def synthetic_outcomes(loans: DataFrame) -> DataFrame:
    """Ground truth per loan, kept apart from the raw fields."""
    names = F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair))
    return loans.select(
        "LOAN_ID",
        F.substring("_source_file", 1, 6).alias("ACQUISITION_QUARTER"),
        names[F.col("EVENT")].alias("EVENT_TYPE"),
        "EVENT_MONTH",
        "RISK_SCORE",
    )


def synthetic_panel(seeds: DataFrame, key: str = "c_custkey") -> DataFrame:
    """Typed loan-month rows with servicer moves, delinquency ramps and zero-balance exits."""
    months = synthetic_loans(seeds, key).selectExpr("*", "explode(sequence(0, MONTHS - 1)) AS i")
    return months.selectExpr(
        "LOAN_ID",
        "add_months(FIRST_MONTH, i) AS ACT_PERIOD",
        "ORIG_DATE",
        "CHANNEL",
        "concat('S', string((KEY + i div 14) % 5)) AS SERVICER",
        "ORIG_RATE",
        "ORIG_UPB",
        "double(ORIG_UPB) * (1 - i / ORIG_TERM) AS CURRENT_UPB",
        "ORIG_TERM",
        "i AS LOAN_AGE",
        "OLTV",
        "OCLTV",
        "DTI",
        "CSCORE_B",
        "CSCORE_C",
        "PURPOSE",
        "PROP",
        "OCC_STAT",
        "STATE",
        """CASE WHEN EVENT = 'D' AND i >= EVENT_MONTH - 1 THEN '03'
            WHEN EVENT = 'D' AND i = EVENT_MONTH - 2 THEN '02'
            WHEN EVENT = 'D' AND i = EVENT_MONTH - 3 THEN '01'
            WHEN EVENT <> 'D' AND KEY % 97 = 0 AND i = 5 THEN 'XX' ELSE '00' END AS DLQ_STATUS""",
        """CASE WHEN i = EVENT_MONTH - 1 AND EVENT = 'P' THEN '01'
            WHEN i = EVENT_MONTH - 1 AND EVENT = 'R' THEN '06' END AS ZERO_BAL_CODE""",
        "_source_file",
    )


def _blank(cells: int) -> Column:
    """So many neighbouring empty cells, as one text."""
    return F.lit(DELIMITER * (cells - 1))


def raw_lines(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Panel rows as headerless delimited text in contract order, with their file stem."""
    cells, empty = [], 0
    for field in fields_of_width(width):
        if field.name not in panel.columns:
            empty += 1
            continue
        if empty:
            cells.append(_blank(empty))
            empty = 0
        value = F.col(field.name)
        if field.kind == "month":
            text = F.date_format(value, "MMyyyy")
        elif field.kind == "decimal":
            text = value.cast(field.spark_type).cast("string")
        else:
            text = value.cast("string")
        cells.append(F.coalesce(text, F.lit("")))
    if empty:
        cells.append(_blank(empty))
    return panel.select(
        F.concat_ws(DELIMITER, *cells).alias("value"),
        F.regexp_replace("_source_file", r"\.csv$", "").alias("quarter"),
    )


def write_raw_files(panel: DataFrame, folder: str, width: int = DEFAULT_WIDTH) -> None:
    """Write raw text under ``folder/quarter=<q>/``; tasks write in parallel, nothing is gathered."""
    write_raw_lines(raw_lines(panel, width), folder)


def write_raw_lines(lines: DataFrame, folder: str) -> None:
    """Write lines under ``folder/quarter=<q>/``, packed: most of a line is delimiters, so files shrink by some twenty times."""
    lines.write.partitionBy("quarter").option("compression", "gzip").text(folder)


def synthetic_releases(months: DataFrame) -> DataFrame:
    """Macro vintages over a frame of month numbers ``i``: first prints plus half-yearly revisions."""
    i = F.col("i")
    series = F.expr(
        """stack(3,
            'UNRATE', 0, 34, 4.0D + 0.01D * i,
            'CSUSHPINSA', 72, 60, 150.0D + 0.5D * i,
            'MORTGAGE30US', 0, 0, 6.0D - 0.01D * i) AS (SERIES_ID, start, lag, base)"""
    )
    observed = F.add_months(F.make_date(F.lit(2004), F.lit(1), F.lit(1)), i.cast("int"))
    revisions = F.when(i % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        months.select("i", observed.alias("OBSERVATION_DATE"), F.explode(revisions).alias("rv"))
        .select("i", "OBSERVATION_DATE", "rv", series)
        .where(i >= F.col("start"))
        .select(
            "SERIES_ID",
            "OBSERVATION_DATE",
            F.date_add("OBSERVATION_DATE", F.col("lag") + 400 * F.col("rv")).alias("AVAILABLE_DATE"),
            (F.col("base") + F.col("rv")).cast("decimal(20,6)").alias("VALUE"),
        )
    )
