"""Publication flows: write once into staging, check what was staged, then promote it by name (SRV7, SRV8)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vintageline.functions.columns import empty_columns
from vintageline.operators.asof import require_coverage, require_valid_releases
from vintageline.operators.gold import GOLD_INPUT, gold_panel, reconciliation_counts, require_reconciled
from vintageline.operators.quality import PASSED, QualityError, quality_report
from vintageline.operators.silver import MONTH_KEY, repeated_marks, servicer_spells, silver_table
from vintageline.operators.splits import require_quarters, require_split_integrity
from vintageline.settings import HPI_SERIES
from vintageline.sources.rawfiles import read_bronze
from vintageline.sources.snapshots import materialize, promote, publish, read_pinned, read_version

GOLD_SOURCES = ("silver", "macro")
# Hashes of repeated loan-months that are sent to the tasks.
MOST_MARKED = 100_000


@dataclass(frozen=True)
class SilverResult:
    version: int
    silver_rows: int
    servicer_rows: int
    quality: list[Row]


@dataclass(frozen=True)
class GoldResult:
    version: int
    counts: Row
    source_versions: dict[str, int]


def publish_silver(
    spark: SparkSession,
    bronze_path: str,
    silver_path: str,
    servicer_path: str,
    quarantine_path: str | None = None,
    staging_path: str | None = None,
) -> SilverResult:
    """Build Silver once into staging, gate the stored copy, promote it with its servicer history.

    Bronze rows are wide, and few loan-months are loaded again: a narrow pass finds these, so that the others are not
    shuffled. Where over ``MOST_MARKED`` are repeated, all rows are.
    """
    staging = staging_path or f"{silver_path}_staging"
    bronze = read_bronze(spark, bronze_path)
    marks = materialize(repeated_marks(bronze, MONTH_KEY), "silver-repeated")
    few = marks.count() <= MOST_MARKED
    publish(silver_table(bronze, marks if few else None), staging, sort_by=MONTH_KEY)
    staged, at = read_pinned(spark, staging)
    report = quality_report(staged).collect()
    failed = [row for row in report if row.status != PASSED]
    if failed:
        if quarantine_path is not None:
            promote(spark, staging, at, quarantine_path)
        raise QualityError(failed)
    version = promote(spark, staging, at, silver_path)
    servicer_version = publish(servicer_spells(staged), servicer_path)
    counted = report[0].observed_rows
    return SilverResult(
        version, counted, read_version(spark, servicer_path, servicer_version).count(), report
    )


def require_gold_sources(versions: Mapping[str, int]) -> dict[str, int]:
    """The build must name exactly its two inputs, each at a non-negative version."""
    if set(versions) != set(GOLD_SOURCES):
        raise ValueError(f"source versions must be given for {GOLD_SOURCES}, got {sorted(versions)}")
    negative = sorted(name for name, version in versions.items() if version < 0)
    if negative:
        raise ValueError(f"negative source versions: {negative}")
    return dict(versions)


def publish_gold(
    spark: SparkSession,
    silver: DataFrame,
    releases: DataFrame,
    gold_path: str,
    source_versions: Mapping[str, int],
    staging_path: str | None = None,
) -> GoldResult:
    """Check inputs, stage the panel, reconcile and check the stored copy, promote with its sources."""
    sources = require_gold_sources(source_versions)
    require_valid_releases(releases)
    require_coverage(silver, releases, allow_early_gaps=True)
    require_coverage(silver, releases, "ORIG_DATE", (HPI_SERIES,), allow_early_gaps=True)
    require_quarters(silver)
    staging = staging_path or f"{gold_path}_staging"
    # Layouts leave whole columns unused, and a row pays for each of them in shuffles and sorts.
    empty = empty_columns(silver, [c for c in silver.columns if c not in GOLD_INPUT])
    panel = gold_panel(silver, releases, empty, ("MODELLING_SPLIT", "LOAN_ID", "ACT_PERIOD"))
    publish(panel, staging, sources, ("MODELLING_SPLIT",))
    staged, at = read_pinned(spark, staging)
    require_split_integrity(staged)
    require_reconciled(silver, staged)
    counts = reconciliation_counts(silver, staged).first()
    version = promote(spark, staging, at, gold_path, sources)
    return GoldResult(version, counts, sources)


def publish_gold_from(
    spark: SparkSession, silver_path: str, macro_path: str, gold_path: str
) -> GoldResult:
    """Pin the newest Silver and macro versions and build from exactly those."""
    silver, silver_version = read_pinned(spark, silver_path)
    releases, macro_version = read_pinned(spark, macro_path)
    return publish_gold(
        spark, silver, releases, gold_path, {"silver": silver_version, "macro": macro_version}
    )


def merge_months(
    incoming: DataFrame, table_path: str, month_column: str = "ACT_PERIOD", keys: tuple[str, ...] = ("LOAN_ID",)
) -> None:
    """Replace the loan-months present in ``incoming``; all other rows stay, and a replay changes nothing.

    The table is partitioned by month and only the months written are touched: their rows of other
    loans are read, joined with what comes in and written together. Rows are rebalanced by month first,
    which splits a heavy month over tasks and keeps small months in few files.
    """
    spark = incoming.sparkSession
    merged = materialize(incoming, "merge-incoming")
    try:
        stored = spark.read.schema(incoming.schema).parquet(table_path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
    else:
        # Bounded by the calendar.
        months = [r[0] for r in merged.select(month_column).distinct().collect()]
        touched = stored.where(F.col(month_column).isin(months))
        # Neither side is bounded, and stored columns are far smaller than their rows: no broadcast.
        coming = merged.select(*keys, month_column).hint("merge")
        others = touched.join(coming, [*keys, month_column], "left_anti")
        merged = materialize(merged.unionByName(others), "merge-rows")
    (
        merged.hint("rebalance", month_column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month_column)
        .parquet(table_path)
    )


def backfill_months(
    history: DataFrame, table_path: str, first_month, last_month, month_column: str = "ACT_PERIOD"
) -> None:
    """Rewrite one closed month range of the table from ``history``."""
    inside = F.col(month_column).between(F.lit(first_month), F.lit(last_month))
    merge_months(history.where(inside), table_path, month_column)
