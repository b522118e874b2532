"""Incremental Silver and Gold: months are merged, and only what they touch is rebuilt.

Every row of a loan lies in one part of Silver, so a loan's survival rows follow from its part alone. Each Gold
part carries the name of the Silver part it was built from: Silver parts without a Gold part of their name are
built, Gold parts whose Silver part is gone are left out, all others are named again. The macro archive matters
only to rows dated on or after the day a changed release became usable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintageline.operators.asof import require_coverage, require_valid_releases
from vintageline.operators.gold import gold_panel, require_reconciled
from vintageline.operators.splits import require_quarters, require_split_integrity
from vintageline.settings import HPI_SERIES
from vintageline.sources.parts import PART, Parts, commit_parts, merge_parts, open_parts, read_parts, write_parts
from vintageline.sources.snapshots import read_pinned, read_version


@dataclass(frozen=True)
class Refreshed:
    """What a refresh published: the version, and the parts built and named again."""

    version: int
    built: tuple[str, ...]
    kept: tuple[str, ...]


def merge_silver(incoming: DataFrame, silver_path: str, slots: int = 64) -> Parts:
    """Merge typed loan-months into the Silver table of parts; loans with a zero-balance code count as closed."""
    return merge_parts(incoming, silver_path, F.trim("ZERO_BAL_CODE") != "", slots)


def first_changed_day(before: DataFrame, after: DataFrame):
    """The first day on which two archives of releases can give different values; None if they are equal."""
    names = before.columns
    changed = before.exceptAll(after.select(*names)).unionByName(after.select(*names).exceptAll(before))
    return changed.agg(F.min(F.greatest("OBSERVATION_DATE", "AVAILABLE_DATE"))).first()[0]


def stale_parts(gold: DataFrame, day) -> set[str]:
    """Parts with a row whose month or origination lies on or after the day; reads these two columns alone."""
    late = (F.col("ACT_PERIOD") >= F.lit(day)) | (F.col("ORIG_DATE") >= F.lit(day))
    return {row[0] for row in gold.where(late).select(PART).distinct().collect()}


def refresh_gold(spark: SparkSession, silver_path: str, macro_path: str, gold_path: str) -> Refreshed:
    """Bring the Gold table of parts up to the newest Silver and macro versions and publish it.

    The checks of a full publication run on the parts that are built. A part all of whose months lie at or after
    an exit has no Gold rows; the manifest names it without a place, so that it is not built again.
    """
    silver = open_parts(spark, silver_path)
    if silver is None:
        raise FileNotFoundError(f"no published table at {silver_path}")
    releases, macro_version = read_pinned(spark, macro_path)
    before = open_parts(spark, gold_path)
    kept: dict[str, str] = {}
    if before is not None:
        kept = {name: place for name, place in before.places.items() if name in silver.places}
        if before.sources["macro"] != macro_version:
            day = first_changed_day(read_version(spark, macro_path, before.sources["macro"]), releases)
            if day is not None:
                stale = stale_parts(read_parts(spark, gold_path, before, kept), day)
                kept = {name: place for name, place in kept.items() if name not in stale}
    names = [name for name in silver.places if name not in kept]
    require_valid_releases(releases)
    rows = read_parts(spark, silver_path, silver, names)
    schema, built = None if before is None else before.schema, {}
    if names or schema is None:
        require_coverage(rows, releases, allow_early_gaps=True)
        require_coverage(rows, releases, "ORIG_DATE", (HPI_SERIES,), allow_early_gaps=True)
        require_quarters(rows)
        panel = gold_panel(rows, releases)
        schema = panel.schema
        built = write_parts(panel, gold_path, names)
        fresh = Parts(-1, built, panel.drop(PART).schema, {})
        staged = read_parts(spark, gold_path, fresh)
        require_split_integrity(staged)
        require_reconciled(rows, staged)
    version = 0 if before is None else before.version + 1
    sources = {"silver": silver.version, "macro": macro_version}
    commit_parts(spark, gold_path, version, kept | built, schema, sources)
    return Refreshed(version, tuple(sorted(names)), tuple(sorted(kept)))


def read_gold(spark: SparkSession, gold_path: str, version: int | None = None) -> DataFrame:
    """Rows of the Gold table of parts, of the newest version by default."""
    found = open_parts(spark, gold_path, version)
    if found is None:
        raise FileNotFoundError(f"no published table at {gold_path}")
    return read_parts(spark, gold_path, found).drop(PART)
