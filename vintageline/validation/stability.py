"""Population and characteristic stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share that stands in for an empty bin, so the log stays finite.
FLOOR = 1e-4


def band(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open band [edge, next edge) a value falls in; NULL values are band -1."""
    index = F.lit(0)
    for edge in edges:
        index = index + (value >= F.lit(float(edge))).cast("int")
    return F.coalesce(index, F.lit(-1))


def quantile_edges(frame: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Approximate inner quantiles per column; a fixed few numbers per column reach the driver."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    row = frame.agg(*(F.percentile_approx(F.col(c).cast("double"), shares).alias(c) for c in columns)).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def stability_index(
    rows: DataFrame, is_current: Column, edges: Mapping[str, Sequence[float]]
) -> DataFrame:
    """Per column: sum over bands of (current - reference share) * ln(current / reference share).

    ``is_current`` tells current rows from reference rows, so both sides are counted in one pass; rows
    where it is NULL belong to neither. One column of scores gives the PSI, several feature columns
    give the CSI of each.
    """
    cells = F.array(
        *(
            F.struct(F.lit(c).alias("column_name"), band(F.col(c).cast("double"), e).alias("band"))
            for c, e in edges.items()
        )
    )
    # One row per column and band.
    counts = (
        rows.select(is_current.alias("now"), F.inline(cells))
        .groupBy("column_name", "band")
        .agg(F.count_if(F.col("now")).alias("cur"), F.count_if(~F.col("now")).alias("ref"))
        .where("cur + ref > 0")
    )
    totals = counts.groupBy("column_name").agg(
        F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur")
    )
    shares = counts.join(totals, "column_name").select(
        "column_name",
        F.greatest(F.try_divide("ref", "all_ref"), F.lit(FLOOR)).alias("e"),
        F.greatest(F.try_divide("cur", "all_cur"), F.lit(FLOOR)).alias("a"),
    )
    return shares.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("bands"),
        F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("stability_index"),
    )
