"""Segment, band, stress-window and proxy-group tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.settings import STRESS_WINDOWS
from vintageline.validation.metrics import auc
from vintageline.validation.stability import band

BAND_EDGES = {
    "CURRENT_LTV": (60.0, 70.0, 80.0, 90.0, 100.0),
    "CLASSIC_FICO": (620.0, 660.0, 700.0, 740.0, 780.0),
    "SEASONING_MONTHS": (6.0, 12.0, 24.0, 36.0, 60.0),
}
PROXY_COLUMNS = ("STATE", "MSA", "PURPOSE", "OCC_STAT", "PROP")


def banded(rows: DataFrame, edges: Mapping[str, Sequence[float]] = BAND_EDGES) -> DataFrame:
    """Add ``<column>_BAND`` with the band index as text; a missing value is band -1."""
    return rows.withColumns(
        {f"{c}_BAND": band(F.col(c).cast("double"), e).cast("string") for c, e in edges.items()}
    )


def _unpivot(rows: DataFrame, dimensions: Sequence[str], *kept: Column) -> DataFrame:
    pairs = F.array(
        *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)
    )
    return rows.select(*kept, F.inline(pairs))


def metrics_by_dimension(
    scored: DataFrame, label: str, probability: str, dimensions: Sequence[str]
) -> DataFrame:
    """Rows, observed rate, mean prediction and Brier for every value of every dimension.

    All dimensions come from one aggregation with grouping sets.
    """
    y, p = F.col(label).cast("double"), F.col(probability)
    rows = scored.where(y.isNotNull() & p.isNotNull()).withColumns(
        {d: F.coalesce(F.col(d).cast("string"), F.lit("missing")) for d in dimensions}
    )
    grouped = rows.groupingSets([[F.col(d)] for d in dimensions], *(F.col(d) for d in dimensions)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(y).alias("observed_rate"),
        F.avg(p).alias("mean_predicted"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    name = F.coalesce(*(F.when(F.col(d).isNotNull(), d) for d in dimensions))
    return grouped.select(
        name.alias("dimension"), F.coalesce(*dimensions).alias("value"),
        "rows", "observed_rate", "mean_predicted", "brier",
    )


def auc_by_dimension(
    scored: DataFrame, label: str, probability: str, dimensions: Sequence[str]
) -> DataFrame:
    """Exact AUC inside every value of every dimension; NULL for one-class values."""
    long = _unpivot(scored, dimensions, F.col(label), F.col(probability)).withColumn(
        "value", F.coalesce("value", F.lit("missing"))
    )
    return auc(long, label, probability, ("dimension", "value"))


def stress_rows(rows: DataFrame, month: str = "ACT_PERIOD", windows=STRESS_WINDOWS) -> DataFrame:
    """Rows inside a stress window, once per window they fall in.

    The window list is a constant inside the expression, so the range join needs no second table.
    """
    table = F.array(
        *(
            F.struct(F.lit(n).alias("stress_window"), F.lit(a).alias("starts"), F.lit(b).alias("ends"))
            for n, (a, b) in windows.items()
        )
    )
    inside = F.filter(table, lambda w: F.col(month).between(w["starts"], w["ends"]))
    hit = F.transform(inside, lambda w: w["stress_window"])
    return rows.select("*", F.explode(hit).alias("stress_window"))


def stress_table(
    rows: DataFrame, label: str, probability: str | None = None, month: str = "ACT_PERIOD"
) -> DataFrame:
    """Loan-months, known labels, events and rates per stress window."""
    columns = [
        F.count(F.lit(1)).alias("rows"),
        F.count(label).alias("labelled"),
        F.sum(F.col(label).cast("bigint")).alias("events"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    ]
    if probability is not None:
        columns.append(F.avg(probability).alias("mean_predicted"))
    return stress_rows(rows, month).groupBy("stress_window").agg(*columns)


def proxy_groups(
    scored: DataFrame,
    label: str,
    probability: str,
    cutoff: float,
    dimensions: Sequence[str] = PROXY_COLUMNS,
) -> DataFrame:
    """Approval-equivalent and default rates per proxy group, beside the group with most approvals.

    A dimension that the frame lacks has one row with no value and no rows, so it is not left out unseen.
    """
    present = [d for d in dimensions if d in scored.columns]
    long = _unpivot(
        scored, present, F.col(label).cast("double").alias("y"), F.col(probability).alias("p")
    ).where("value IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL")
    groups = long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("y").alias("observed_rate"),
        F.avg("p").alias("mean_predicted"),
        F.avg((F.col("p") < cutoff).cast("double")).alias("approval_rate"),
    )
    best = groups.groupBy("dimension").agg(F.max("approval_rate").alias("best"))
    rated = (
        groups.join(best, "dimension")
        .withColumn("approval_ratio", F.try_divide("approval_rate", "best"))
        .drop("best")
    )
    absent = [(d,) for d in dimensions if d not in scored.columns]
    if not absent:
        return rated
    missing = scored.sparkSession.createDataFrame(absent, "dimension string").withColumn("rows", F.lit(0).cast("long"))
    return rated.unionByName(missing, allowMissingColumns=True)
