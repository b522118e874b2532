"""Ceteris-paribus sweeps of the constrained drivers (VAL4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintageline.settings import FEATURES, RISK_DIRECTION, SWEEP_BOUNDS


class MonotonicityError(AssertionError):
    """A constrained driver reverses its risk direction."""


def sweep_grid(
    spark: SparkSession,
    medians: Mapping[str, float],
    bounds: Mapping[str, tuple[float, float]] = SWEEP_BOUNDS,
    points: int = 101,
) -> DataFrame:
    """Rows that vary one driver over its bounds while the others stay at their medians."""
    if points < 2:
        raise ValueError("a sweep needs at least two points")
    for wanted, given, what in ((FEATURES, medians, "medians"), (RISK_DIRECTION, bounds, "bounds")):
        absent = sorted(set(wanted) - set(given))
        if absent:
            raise ValueError(f"{what} lack {absent}")
    backwards = sorted(f for f in RISK_DIRECTION if bounds[f][0] >= bounds[f][1])
    if backwards:
        raise ValueError(f"sweep bounds are not increasing for {backwards}")
    drivers = [(f, float(d), *map(float, bounds[f])) for f, d in RISK_DIRECTION.items()]
    rows = spark.createDataFrame(drivers, "swept string, direction double, low double, high double")
    share = F.col("step") / (points - 1)
    return rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        "swept", "direction", "step",
        *(
            F.when(F.col("swept") == f, F.col("low") + share * (F.col("high") - F.col("low")))
            .otherwise(F.lit(float(medians[f])))
            .alias(f)
            for f in FEATURES
        ),
    )


def sweep_report(grid: DataFrame, probability: Column) -> DataFrame:
    """Probability range and worst step against the direction, per driver."""
    scored = grid.select("swept", "direction", "step", probability.alias("p"))
    along = Window.partitionBy("swept").orderBy("step")
    against = -F.col("direction") * (F.col("p") - F.lag("p").over(along))
    return (
        scored.withColumn("reversal", against)
        .groupBy(F.col("swept").alias("feature"), F.col("direction").cast("int").alias("direction"))
        .agg(
            F.min("p").alias("minimum_probability"),
            F.max("p").alias("maximum_probability"),
            F.greatest(F.max("reversal"), F.lit(0.0)).alias("worst_violation"),
        )
    )


def require_monotone(report: DataFrame, tolerance: float = 1e-12) -> list:
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    rows = report.collect()
    broken = [r for r in rows if r.worst_violation > tolerance]
    if broken:
        raise MonotonicityError(
            "; ".join(f"{r.feature} reverses by {r.worst_violation:.12g}" for r in broken)
        )
    return rows
