"""Running totals over a global order without gathering rows in one task.

Values are cut into slices at approximate quantiles, each slice is summed on its own, and the few
per-slice totals are accumulated and handed back. The quantiles only balance the slices; the totals
are exact wherever the cuts fall. Cuts are one scalar subquery, evaluated once per query, so every
task and every retried task places a value in the same slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import hex_bucket


def slice_count(frame: DataFrame) -> int:
    """Power of two near the session's shuffle parallelism."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return 1 << max(3, min(12, (partitions - 1).bit_length()))


def _slice_of(value: Column, cuts: Column, slices: int) -> Column:
    """Number of cuts below the value, by halving steps."""
    steps = F.array(*(F.lit(slices >> k) for k in range(1, slices.bit_length())))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at),
    )


def sliced(
    frame: DataFrame, order: str, cuts_from: DataFrame | None = None
) -> DataFrame:
    """Add ``_slice``, an order-preserving slice number of about equal row counts.

    ``cuts_from`` may name a cheaper frame with a like distribution of ``order`` to take the cuts from.
    """
    slices = slice_count(frame)
    shares = F.array(*(F.lit(k / slices) for k in range(1, slices)))
    source = frame if cuts_from is None else cuts_from
    cuts = source.agg(F.percentile_approx(order, shares)).scalar()
    placed = _slice_of(F.col(order), F.col("_cuts"), slices)
    return frame.withColumn("_cuts", cuts).withColumn("_slice", placed).drop("_cuts")


def before_in_slice(by: Sequence[str], order: str):
    """Window over the rows of the same slice with a smaller order value."""
    return (
        Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )


def slices_before(by: Sequence[str]):
    """Window over the group's earlier slices; a group has at most ``slice_count`` of them."""
    return Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def totals_below(
    frame: DataFrame, order: str, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<measure>_below``: the sum over rows of the group with a smaller ``order`` value.

    The frame must hold one row per group and order value; aggregate it to that grain first.
    """
    rows = sliced(frame, order)
    offsets = (
        rows.groupBy(*by, "_slice")
        .agg(*(F.sum(m).alias(m) for m in measures))
        .select(*by, "_slice", *(or_zero(F.sum(m).over(slices_before(by))).alias(f"_off_{m}") for m in measures))
    )
    inside = before_in_slice(by, order)
    return (
        rows.join(offsets, [*by, "_slice"])
        .withColumns(
            {f"{m}_below": F.col(f"_off_{m}") + or_zero(F.sum(m).over(inside)) for m in measures}
        )
        .drop("_slice", *(f"_off_{m}" for m in measures))
    )


def dense_index(keys: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """Number distinct text keys 0..n-1 in the order of (md5 bucket, key)."""
    bucketed = keys.select(key).distinct().withColumn("_bucket", hex_bucket(F.col(key), buckets))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``buckets`` rows.
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return bucketed.join(F.broadcast(offsets), "_bucket").select(
        key, (F.col("_offset") + rank - 1).alias("idx")
    )
