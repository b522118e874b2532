"""Acquisition summary and its comparison with a published table (AGG1-AGG6, JN7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import lowest_score, need_columns, source_quarter, weighted_mean

SUMMARY_INPUT = (
    "LOAN_ID", "ACT_PERIOD", "ORIG_DATE", "ORIG_UPB", "ORIG_RATE", "OLTV", "OCLTV", "DTI",
    "CSCORE_B", "CSCORE_C",
)
METRICS = (
    "LOAN_COUNT", "TOTAL_ORIGINAL_UPB_MILLIONS", "AVERAGE_ORIGINAL_UPB", "CLASSIC_FICO", "OLTV",
    "OCLTV", "DTI", "NOTE_RATE",
)
# How far each metric may be from the published display value.
TOLERANCES = dict(zip(METRICS, (0.0, 0.5, 0.5, 0.5, 0.05, 0.05, 0.05, 0.05)))

# Published rows, one per origination year and the total, metrics in the order above.
PUBLISHED_ROWS = (
    ("2005", 1446003, 252235, 174436, 721, 69.7, 71.7, 37.6, 5.8),
    ("2007", 1252409, 245723, 196200, 719, 72.2, 74.3, 38.9, 6.3),
    ("2012", 2680144, 608112, 226895, 766, 68.9, 70.2, 31.1, 3.6),
    ("2016", 2353822, 555054, 235810, 752, 73.6, 74.3, 33.5, 3.7),
    ("2018", 1787453, 419624, 234761, 743, 77.8, 78.3, 37.6, 4.8),
    ("Total", 57864281, 12724660, 219905, 747, 71.9, 72.7, 34.6, 4.7),
)
PUBLISHED_QUARTERS = [f"{y}Q{q}" for y in range(2000, 2026) for q in (1, 2, 3, 4)] + ["2026Q1"]


class SummaryError(RuntimeError):
    """The summary or its population does not match the publication."""


def latest_per_loan(silver: DataFrame) -> DataFrame:
    """Each loan's last month (WIN8); row-hash ties, pruned in the map tasks before the shuffle."""
    order = Window.partitionBy("LOAN_ID").orderBy(
        F.col("ACT_PERIOD").desc(), F.xxhash64(*sorted(silver.columns)).desc()
    )
    return silver.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def acquisition_summary(silver: DataFrame) -> DataFrame:
    """Per origination year and in total: loans, balances and balance-weighted averages.

    Year rows and the ``Total`` row come from one rollup.
    """
    need_columns(silver, SUMMARY_INPUT, "acquisition summary")
    loans = (
        latest_per_loan(silver.select(*SUMMARY_INPUT))
        .where(F.col("ORIG_DATE").isNotNull())
        .select(
            F.date_format("ORIG_DATE", "yyyy").alias("YEAR"),
            "ORIG_UPB",
            lowest_score("CSCORE_B", "CSCORE_C").alias("SCORE"),
            "OLTV",
            F.coalesce("OCLTV", "OLTV").alias("OCLTV"),
            "DTI",
            "ORIG_RATE",
        )
    )
    weight = F.col("ORIG_UPB")
    upb = weight.cast("decimal(20,2)")
    return (
        loans.rollup("YEAR")
        .agg(
            F.grouping_id().alias("_level"),
            F.count(F.lit(1)).alias("LOAN_COUNT"),
            (F.sum(upb).cast("double") / 1e6).alias("TOTAL_ORIGINAL_UPB_MILLIONS"),
            F.try_divide(F.sum(upb).cast("double"), F.count(upb)).alias("AVERAGE_ORIGINAL_UPB"),
            weighted_mean(F.col("SCORE"), weight).alias("CLASSIC_FICO"),
            weighted_mean(F.col("OLTV"), weight).alias("OLTV"),
            weighted_mean(F.col("OCLTV"), weight).alias("OCLTV"),
            weighted_mean(F.col("DTI"), weight).alias("DTI"),
            weighted_mean(F.col("ORIG_RATE"), weight).alias("NOTE_RATE"),
        )
        .select(
            F.when(F.col("_level") == 0, F.col("YEAR")).otherwise("Total").alias("ORIGINATION_YEAR"),
            *METRICS,
        )
        .orderBy((F.col("ORIGINATION_YEAR") == "Total"), "ORIGINATION_YEAR")
    )


def observed_quarters(silver: DataFrame) -> DataFrame:
    """Distinct quarters read from provenance; a file without one gives a NULL row (AGG4)."""
    need_columns(silver, ("_source_file",), "observed quarters")
    return (
        silver.select("_source_file")
        .distinct()
        .select(source_quarter(F.col("_source_file")).alias("quarter"))
        .distinct()
    )


def quarter_frame(spark: SparkSession, quarters: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(q,) for q in quarters], "quarter string")


def population_differences(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Quarters on one side only, marked ``missing`` or ``extra`` (AGG5, SET3)."""
    missing = expected.exceptAll(observed.distinct()).withColumn("problem", F.lit("missing"))
    extra = observed.distinct().exceptAll(expected).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def require_population(silver: DataFrame, quarters: Iterable[str] = PUBLISHED_QUARTERS) -> list[str]:
    """Fail closed unless the observed quarters equal the published ones; quarters are calendar-bounded."""
    observed = observed_quarters(silver)
    differences = population_differences(observed, quarter_frame(silver.sparkSession, quarters)).collect()
    if any(r.quarter is None for r in differences):
        raise ValueError("a source file name holds no acquisition quarter")
    if differences:
        missing = sorted(r.quarter for r in differences if r.problem == "missing")
        extra = sorted(r.quarter for r in differences if r.problem == "extra")
        raise SummaryError(f"populations differ: missing={missing}, extra={extra}")
    return sorted(quarters)


def published_table(spark: SparkSession) -> DataFrame:
    """The pinned published rows as a frame."""
    rows = [(year, count, *map(float, values)) for year, count, *values in PUBLISHED_ROWS]
    columns = ", ".join(f"{m} {'bigint' if m == 'LOAN_COUNT' else 'double'}" for m in METRICS)
    return spark.createDataFrame(rows, f"ORIGINATION_YEAR string, {columns}")


def _tall(summary: DataFrame, value: str) -> DataFrame:
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    return summary.selectExpr("ORIGINATION_YEAR", f"stack({len(METRICS)}, {pairs}) AS (metric, {value})")


def summary_differences(
    actual: DataFrame, expected: DataFrame, tolerances: dict[str, float] = TOLERANCES
) -> DataFrame:
    """Expected cells that are absent, NULL or further away than their tolerance (JN7)."""
    allowed = F.create_map(*(F.lit(x) for pair in tolerances.items() for x in pair))
    gap = F.abs(F.col("actual") - F.col("expected"))
    return (
        _tall(expected, "expected")
        .join(_tall(actual, "actual"), ["ORIGINATION_YEAR", "metric"], "left")
        .withColumn("tolerance", allowed[F.col("metric")])
        .where(F.col("actual").isNull() | (gap > F.col("tolerance")))
    )


def require_published_summary(silver: DataFrame) -> int:
    """Population check, then summary, then comparison; returns the number of rows compared (AGG6)."""
    spark = silver.sparkSession
    require_population(silver)
    expected = published_table(spark)
    differences = summary_differences(acquisition_summary(silver), expected).collect()
    if differences:
        raise SummaryError(
            "; ".join(f"{r.ORIGINATION_YEAR}.{r.metric}: {r.actual} for {r.expected}" for r in differences)
        )
    return expected.count()
