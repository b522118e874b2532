"""Macro release archives: JSON files to a typed release table (SRC9, SRC10, SNK3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.operators.asof import MacroError, require_valid_releases
from vintageline.settings import MACRO_SERIES
from vintageline.sources.snapshots import publish

RELEASE_SCHEMA = T.StructType(
    [
        T.StructField("SERIES_ID", T.StringType(), False),
        T.StructField("OBSERVATION_DATE", T.DateType(), False),
        T.StructField("AVAILABLE_DATE", T.DateType(), False),
        T.StructField("VALUE", T.DecimalType(20, 6), False),
    ]
)
_FILE_SCHEMA = (
    "observations array<struct<date string, realtime_start string, value string>>, _corrupt string"
)


def read_archive(
    spark: SparkSession, folder: str, series: Sequence[str] = MACRO_SERIES
) -> DataFrame:
    """Raw observations of ``folder/<series>.json``, one row each, with a flag for broken files."""
    parts = None
    for name in series:
        try:
            file = (
                spark.read.schema(_FILE_SCHEMA)
                .option("multiLine", "true")
                .option("columnNameOfCorruptRecord", "_corrupt")
                .json(f"{folder}/{name}.json")
            )
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" in str(problem):
                raise FileNotFoundError(f"{folder}/{name}.json") from problem
            raise
        rows = file.select(
            F.lit(name).alias("SERIES_ID"),
            (F.col("_corrupt").isNotNull() | F.col("observations").isNull()).alias("broken_file"),
            F.explode_outer("observations").alias("o"),
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def parse_archive(archive: DataFrame) -> DataFrame:
    """Typed observations plus ``problem``; a ``.`` value is a gap in the series and is dropped."""
    iso = r"^\d{4}-\d{2}-\d{2}$"

    def day(text):
        return F.when(text.rlike(iso), F.try_to_date(text, "yyyy-MM-dd"))

    observed, available = day(F.col("o.date")), day(F.col("o.realtime_start"))
    value = F.trim("o.value").try_cast("decimal(20,6)")
    problem = (
        F.when(F.col("broken_file"), "file")
        .when(F.col("o").isNull(), "no_observations")
        .when(observed.isNull(), "date")
        .when(available.isNull(), "realtime_start")
        .when(value.isNull(), "value")
    )
    return archive.where(F.col("broken_file") | F.col("o.value").isNull() | (F.col("o.value") != ".")).select(
        "SERIES_ID",
        observed.alias("OBSERVATION_DATE"),
        available.alias("AVAILABLE_DATE"),
        value.alias("VALUE"),
        problem.alias("problem"),
    )


def typed_releases(frame: DataFrame) -> DataFrame:
    """Cast to the release table's types (SRC10)."""
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RELEASE_SCHEMA))


def load_releases(
    spark: SparkSession, folder: str, series: Sequence[str] = MACRO_SERIES
) -> DataFrame:
    """Parse the archive; any broken file, malformed row or series without a value raises."""
    parsed = parse_archive(read_archive(spark, folder, series))
    problems = parsed.where("problem IS NOT NULL").groupBy("SERIES_ID", "problem").count().collect()
    if problems:
        raise MacroError(
            "release archive broken: "
            + ", ".join(f"{r.SERIES_ID} {r['problem']} x{r['count']}" for r in problems)
        )
    held = {r.SERIES_ID for r in parsed.select("SERIES_ID").distinct().collect()}
    empty = [s for s in series if s not in held]
    if empty:
        raise MacroError(f"release archive holds no observations for {empty}")
    return typed_releases(parsed)


def publish_releases(spark: SparkSession, folder: str, path: str) -> dict[str, int]:
    """Load, validate, publish as the next version; rows per series (SNK3)."""
    releases = load_releases(spark, folder)
    require_valid_releases(releases)
    publish(releases, path)
    return {r.SERIES_ID: r["count"] for r in releases.groupBy("SERIES_ID").count().collect()}
