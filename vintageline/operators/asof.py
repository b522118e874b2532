"""Bitemporal as-of join of macro releases (JN1-JN4, WIN9, AGG7, Q10).

A release can be used from the later of its observation and availability dates, and among usable
releases the one with the latest observation (then latest availability) wins. So the value as of a
date is a running maximum over usable-from dates. Releases are first reduced to one row per series
and day, and as-of dates to distinct days; the running maximum then walks at most two rows per
calendar day and series, however large the panel or the archive. The resulting one-row-per-day table
is what meets the panel, and its size is bounded by the calendar.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import need_columns
from vintageline.settings import MACRO_SERIES

RELEASE_COLUMNS = ("SERIES_ID", "OBSERVATION_DATE", "AVAILABLE_DATE", "VALUE")


class MacroError(ValueError):
    """Releases break their contract."""


class CoverageError(MacroError):
    """An as-of date has no usable release, or a series is missing altogether."""


def _check_arguments(series: Sequence[str], prefix: str) -> None:
    if not series:
        raise ValueError("at least one series is needed")
    unknown = sorted(set(series) - set(MACRO_SERIES))
    if unknown:
        raise ValueError(f"unknown macro series: {unknown}")
    if not re.fullmatch(r"([A-Z][A-Z0-9]*_)*", prefix):
        raise ValueError(f"prefix {prefix!r} must be upper-case words each ending in '_'")


def release_violations(releases: DataFrame) -> DataFrame:
    """One row per broken rule with its row count (Q10): nulls, unknown series, duplicate vintages."""
    need_columns(releases, RELEASE_COLUMNS, "macro releases")
    key = RELEASE_COLUMNS[:3]
    nulls = F.lit(False)
    for name in RELEASE_COLUMNS:
        nulls = nulls | F.col(name).isNull()
    by_vintage = releases.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(nulls).alias("nulls")
    )
    known = F.col("SERIES_ID").isin(*MACRO_SERIES)
    counts = by_vintage.agg(
        F.sum("nulls").alias("null_value"),
        F.sum(F.when(~known, F.col("n"))).alias("unknown_series"),
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("duplicate_vintage"),
    )
    rules = ("null_value", "unknown_series", "duplicate_vintage")
    pairs = ", ".join(f"'{r}', coalesce({r}, 0)" for r in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) AS (rule, violations)"))


def require_valid_releases(releases: DataFrame) -> None:
    broken = release_violations(releases).where("violations > 0").collect()
    if broken:
        raise MacroError("macro releases broken: " + ", ".join(f"{r.rule}={r.violations}" for r in broken))


def as_of_dates(frame: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-NULL dates of one or more date columns, read in one narrow pass."""
    return (
        frame.select(F.explode(F.array(*columns)).alias("AOD")).where(F.col("AOD").isNotNull()).distinct()
    )


def latest_releases(
    dates: DataFrame, releases: DataFrame, series: Sequence[str] = MACRO_SERIES
) -> DataFrame:
    """Per (AOD, SERIES_ID): the release in force, absent when none is usable yet (WIN9)."""
    best = F.max(F.struct("OBSERVATION_DATE", "AVAILABLE_DATE", "VALUE")).alias("best")
    usable = (
        releases.where(F.col("SERIES_ID").isin(*series))
        .groupBy("SERIES_ID", F.greatest("OBSERVATION_DATE", "AVAILABLE_DATE").alias("day"))
        .agg(best)
        .select("SERIES_ID", "day", F.lit(False).alias("asked"), "best")
    )
    nothing = F.lit(None).cast(usable.schema["best"].dataType)
    asked = dates.select(
        F.explode(F.array(*(F.lit(s) for s in series))).alias("SERIES_ID"),
        F.col("AOD").alias("day"),
        F.lit(True).alias("asked"),
        nothing.alias("best"),
    )
    through_day = (
        Window.partitionBy("SERIES_ID")
        .orderBy("day")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        usable.unionByName(asked)
        .withColumn("best", F.max("best").over(through_day))
        .where(F.col("asked") & F.col("best").isNotNull())
        .select(F.col("day").alias("AOD"), "SERIES_ID", "best.*")
    )


def wide_releases(latest: DataFrame, series: Sequence[str], prefix: str = "") -> DataFrame:
    """Long to wide: value, observation and availability date per series, one row per day (AGG7)."""
    _check_arguments(series, prefix)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("SERIES_ID") == name, F.col(column)))

    columns = []
    for name in series:
        columns += [
            of(name, "VALUE").alias(f"{prefix}{name}"),
            of(name, "OBSERVATION_DATE").alias(f"{prefix}{name}_OBSERVATION_DATE"),
            of(name, "AVAILABLE_DATE").alias(f"{prefix}{name}_AVAILABLE_DATE"),
        ]
    return latest.groupBy("AOD").agg(*columns)


def join_releases(
    frame: DataFrame,
    releases: DataFrame,
    as_of_column: str = "ACT_PERIOD",
    series: Sequence[str] = MACRO_SERIES,
    prefix: str = "",
    dates: DataFrame | None = None,
) -> DataFrame:
    """Add the releases in force on each row's as-of date; no release in force leaves NULLs (JN1).

    ``dates`` (column AOD) may come from a cheaper place than the frame, such as the stored table the
    frame was built from; it has to cover the frame's dates. Joins that pass the same ``dates`` share
    one running maximum.
    """
    need_columns(frame, (as_of_column,), "as-of join")
    _check_arguments(series, prefix)
    days = as_of_dates(frame, as_of_column) if dates is None else dates
    wide = wide_releases(latest_releases(days, releases), series, prefix)
    # One row per calendar day at most, so the broadcast is bounded whatever the panel holds.
    return frame.join(F.broadcast(wide), F.col(as_of_column) == wide["AOD"], "left").drop("AOD")


def coverage(
    frame: DataFrame,
    releases: DataFrame,
    as_of_column: str = "ACT_PERIOD",
    series: Sequence[str] = MACRO_SERIES,
) -> DataFrame:
    """Per series: releases held, as-of dates asked, and dates with a release in force (JN4)."""
    _check_arguments(series, "")
    days = as_of_dates(frame, as_of_column)
    parts = (
        releases.where(F.col("SERIES_ID").isin(*series))
        .groupBy("SERIES_ID")
        .agg(F.count(F.lit(1)).alias("held"))
        .selectExpr("SERIES_ID", "held", "0L AS asked", "0L AS matched")
    ).unionByName(
        latest_releases(days, releases, series)
        .groupBy("SERIES_ID")
        .agg(F.count(F.lit(1)).alias("matched"))
        .selectExpr("SERIES_ID", "0L AS held", "0L AS asked", "matched")
    ).unionByName(
        days.agg(F.count(F.lit(1)).alias("asked")).select(
            F.explode(F.array(*(F.lit(s) for s in series))).alias("SERIES_ID"),
            F.lit(0).cast("bigint").alias("held"),
            "asked",
            F.lit(0).cast("bigint").alias("matched"),
        )
    )
    return parts.groupBy("SERIES_ID").agg(
        F.sum("held").alias("releases_held"),
        F.sum("asked").alias("dates_asked"),
        F.sum("matched").alias("dates_matched"),
    )


def require_coverage(
    frame: DataFrame,
    releases: DataFrame,
    as_of_column: str = "ACT_PERIOD",
    series: Sequence[str] = MACRO_SERIES,
    allow_early_gaps: bool = False,
) -> None:
    """A series without any release always fails; dates before its first release fail unless allowed."""
    rows = coverage(frame, releases, as_of_column, series).collect()
    empty = sorted(r.SERIES_ID for r in rows if not r.releases_held)
    if empty:
        raise CoverageError(f"no releases at all for {empty}")
    short = {r.SERIES_ID: r.dates_asked - r.dates_matched for r in rows if r.dates_matched < r.dates_asked}
    if short and not allow_early_gaps:
        raise CoverageError(f"as-of dates without a release in force: {short}")


def lookahead_rows(panel: DataFrame, as_of: dict[str, Sequence[str]]) -> DataFrame:
    """Count joined release dates later than the row's as-of date, per column (VAL7)."""
    aggregates, names = [], []
    for day, series in as_of.items():
        for name in series:
            for suffix in ("OBSERVATION_DATE", "AVAILABLE_DATE"):
                column = f"{name}_{suffix}"
                names.append(column)
                aggregates.append(F.count_if(F.col(column) > F.col(day)).alias(column))
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return panel.agg(*aggregates).select(F.expr(f"stack({len(names)}, {pairs}) AS (column_name, late_rows)"))
