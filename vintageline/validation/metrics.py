"""Exact discrimination and calibration metrics (VAL1, VAL2, X1-X3, X6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.functions.ordered import (
    before_in_slice,
    or_zero,
    sliced,
    slices_before,
    totals_below,
)


def by_score(
    scored: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Events and non-events per distinct score: the grain all rank metrics work on."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    event = F.col(label) == 1
    return scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(event, w).otherwise(0)).alias("events"),
        F.sum(F.when(event, 0).otherwise(w)).alias("others"),
    )


def auc(
    scored: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: Column | None = None,
    cuts_from: DataFrame | None = None,
) -> DataFrame:
    """Tie-aware AUC and Gini per group; NULL when a group has one class only (VAL1).

    Each slice of the score range counts the pairs won inside it; pairs across slices follow from the
    slice totals, so the rows are ordered only within slices.
    """
    rows = sliced(by_score(scored, label, score, by, weight), score, cuts_from)
    events, others = F.col("events").cast("double"), F.col("others").cast("double")
    below = or_zero(F.sum("others").over(before_in_slice(by, score)))
    per_slice = (
        rows.withColumn("won", events * (below + others / 2))
        .groupBy(*by, "_slice")
        .agg(*(F.sum(c).alias(c) for c in ("events", "others", "won")))
        .withColumn("below", or_zero(F.sum("others").over(slices_before(by))))
    )
    won = F.sum(F.col("won") + events * F.col("below"))
    return per_slice.groupBy(*by).agg(
        F.sum("events").alias("events"),
        F.sum("others").alias("non_events"),
        F.try_divide(won, F.sum(events) * F.sum(others)).alias("auc"),
    ).withColumn("gini", 2 * F.col("auc") - 1)


def ks_statistic(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the cumulative event and non-event shares."""
    grouped = by_score(scored, label, score, by)
    ordered = totals_below(grouped, score, ["events", "others"], by)
    totals = grouped.groupBy(*by).agg(F.sum("events").alias("all_events"), F.sum("others").alias("all_others"))
    gap = F.abs(
        (F.col("events_below") + F.col("events")) / F.col("all_events")
        - (F.col("others_below") + F.col("others")) / F.col("all_others")
    )
    if by:
        joined = ordered.join(totals, list(by))
    else:
        joined = ordered.withColumns(
            {c: totals.select(c).scalar() for c in totals.columns}
        )
    return joined.where("all_events > 0 AND all_others > 0").groupBy(*by).agg(F.max(gap).alias("ks"))


def brier(scored: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error, base rate and skill against the base-rate forecast (VAL2, X3)."""
    y, p = F.col(label).cast("double"), F.col(probability)
    rate = F.avg(y)
    return (
        scored.where(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier"), rate.alias("base_rate"))
        .withColumn(
            "brier_skill",
            1 - F.try_divide(F.col("brier"), F.col("base_rate") * (1 - F.col("base_rate"))),
        )
    )


def brier_change(scored: DataFrame, label: str, raw: str, calibrated: str) -> DataFrame:
    """Raw and calibrated Brier in one pass; a negative change is an improvement."""
    y = F.col(label).cast("double")

    def error(name: str) -> Column:
        return F.avg((F.col(name) - y) * (F.col(name) - y))

    return scored.where(y.isNotNull()).agg(
        error(raw).alias("brier_raw"), error(calibrated).alias("brier_calibrated")
    ).withColumn("brier_change", F.col("brier_calibrated") - F.col("brier_raw"))


def calibration_by_quantile(
    scored: DataFrame, label: str, probability: str, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Mean prediction and observed rate per score quantile.

    A quantile is the share of rows with a lower score, so equal scores always share a bin.
    """
    grouped = by_score(scored, label, probability, by).withColumn("n", F.col("events") + F.col("others"))
    ordered = totals_below(grouped, probability, ["n"], by)
    if by:
        sizes = grouped.groupBy(*by).agg(F.sum("n").alias("group_rows"))
        ordered = ordered.join(sizes, list(by))
    else:
        ordered = ordered.withColumn("group_rows", grouped.agg(F.sum("n")).scalar())
    quantile = (F.floor(F.col("n_below") * bins / F.col("group_rows")) + 1).cast("int")
    return ordered.groupBy(*by, quantile.alias("bin")).agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col(probability) * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("events") / F.sum("n")).alias("observed_rate"),
    )


def predicted_vs_actual(
    scored: DataFrame, label: str, probability: str, segments: Sequence[str]
) -> DataFrame:
    """Mean prediction, observed rate and their ratio per segment (X2 by vintage, X6)."""
    y, p = F.col(label).cast("double"), F.col(probability)
    return (
        scored.where(y.isNotNull() & p.isNotNull())
        .groupBy(*segments)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(p).alias("mean_predicted"),
            F.avg(y).alias("observed_rate"),
        )
        .withColumn("actual_to_predicted", F.try_divide("observed_rate", "mean_predicted"))
    )
