"""Ranked reason codes per scored row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.models.boosting import BoostedModel
from vintageline.models.challenger import Calibrated
from vintageline.models.scorecard import FACTOR, Scorecard
from vintageline.models.shapley import Reference, contributions

REASONS = {
    "CLASSIC_FICO": "Credit score at origination is low",
    "OLTV": "Loan is large against the property value at origination",
    "DTI": "Debt payments are high against income",
    "CURRENT_LTV": "Balance is high against the estimated current property value",
    "SEASONING_MONTHS": "Loan is at an age with more defaults",
    "UNRATE": "Unemployment is high",
    "MORTGAGE30US": "Market mortgage rates are unfavourable",
}


def ranked_shortfalls(
    rows: DataFrame,
    keys: list[str],
    points: Mapping[str, Column],
    best: Mapping[str, float],
    top: int = 4,
    reasons: Mapping[str, str] = REASONS,
) -> DataFrame:
    """The ``top`` features whose points are furthest below their maximum, ranked from one.

    Ranking sorts a short array inside each row, so nothing is shuffled. Equal shortfalls rank by name;
    features at their maximum are not reasons.
    """
    entries = F.array(
        *(
            F.struct((-(F.lit(float(best[f])) - p)).alias("negative"), F.lit(f).alias("feature"))
            for f, p in points.items()
        )
    )
    short = F.filter(entries, lambda e: e["negative"] < -1e-9)
    ranked = F.slice(F.array_sort(short), 1, top)
    text = F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair))
    return rows.select(*keys, F.posexplode(ranked)).select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        F.col("col.feature").alias("feature"),
        (-F.col("col.negative")).alias("shortfall"),
        F.coalesce(text[F.col("col.feature")], F.col("col.feature")).alias("reason"),
    )


def scorecard_reasons(rows: DataFrame, card: Scorecard, keys: list[str], top: int = 4) -> DataFrame:
    """Reason codes of a fitted scorecard: points lost against each feature's best bin."""
    best = {}
    for feature, weight in card.coefficients.items():
        bins = card.bins[feature]
        logit = min(weight * w for w in (*bins.woe, bins.missing_woe))
        best[feature] = -FACTOR * logit
    points = {
        f: F.lit(-FACTOR * weight) * card.bins[f].weight() for f, weight in card.coefficients.items()
    }
    return ranked_shortfalls(rows, keys, points, best, top)


def boosted_reasons(
    rows: DataFrame, model: BoostedModel | Calibrated, reference: Reference, keys: list[str], top: int = 4
) -> DataFrame:
    """Reason codes of boosted trees: features that raise the log-odds most against a reference row.

    A calibration moves all scores alike, so a calibrated model has the reasons of its trees. The shortfall is in
    log-odds.
    """
    trees = model.model if isinstance(model, Calibrated) else model
    if not isinstance(trees, BoostedModel):
        raise TypeError("reasons by Shapley values need boosted trees")
    parts = "_" + "_".join(rows.columns)
    shared = rows.withColumn(parts, contributions(trees, reference))
    points = {f: -F.col(f"`{parts}`")[k] for k, f in enumerate(trees.features)}
    return ranked_shortfalls(shared, keys, points, dict.fromkeys(trees.features, 0.0), top)
