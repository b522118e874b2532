"""Smoothed marginal event rate by loan age (MOD1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.functions.columns import need_columns


@dataclass(frozen=True)
class MarginalRates:
    """Rates per age; the portfolio rate stands in for ages never seen."""

    rates: DataFrame
    age: str

    def predict(self, rows: DataFrame, name: str = "baseline_probability") -> DataFrame:
        # One row per loan age in months, so the broadcast is bounded by the longest term.
        # The age NULL carries the portfolio rate.
        by_age = self.rates.where(F.col("age").isNotNull()).select("age", "rate")
        overall = self.rates.where(F.col("age").isNull()).select("rate")
        return (
            rows.join(F.broadcast(by_age), F.col(self.age) == F.col("age"), "left")
            .withColumn(name, F.coalesce("rate", overall.scalar()))
            .drop("age", "rate")
        )


def fit_marginal_rates(
    rows: DataFrame, target: str, age: str = "SEASONING_MONTHS", smoothing: float = 20.0
) -> MarginalRates:
    """(events + smoothing * overall) / (rows + smoothing) per age, overall rate under a NULL age."""
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    need_columns(rows, (age, target), "marginal rates")
    counts = (
        rows.where(F.col(age).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(age).alias("age"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("events"))
    )
    overall = counts.agg((F.sum("events") / F.sum("n")).alias("rate"))
    smoothed = (F.col("events") + smoothing * F.col("overall")) / (F.col("n") + smoothing)
    rates = counts.withColumn("overall", overall.scalar()).select(
        "age", "n", "events", smoothed.alias("rate")
    )
    portfolio = counts.agg(
        F.lit(None).cast("int").alias("age"),
        F.sum("n").alias("n"),
        F.sum("events").alias("events"),
        (F.sum("events") / F.sum("n")).alias("rate"),
    )
    return MarginalRates(rates.unionByName(portfolio), age)


def require_usable(rows: DataFrame, target: str, age: str = "SEASONING_MONTHS") -> None:
    """Refuse an empty frame, a missing age or a label other than 0 and 1."""
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(age).isNull()).alias("no_age"),
        F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)).alias("bad_label"),
    ).first()
    if not facts.n or facts.no_age or facts.bad_label:
        raise ValueError(f"baseline rows unusable: {facts.asDict()}")
