"""Logistic scorecard on weight-of-evidence bins, scaled to points (MOD4)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.models.binning import FeatureBins, bin_counts, fit_bins, woe_table
from vintageline.models.newton import LogisticFit, fit_newton
from vintageline.settings import BASE_ODDS, BASE_POINTS, FEATURES, PDO
from vintageline.sources.snapshots import materialize

FACTOR = PDO / math.log(2)
OFFSET = BASE_POINTS - FACTOR * math.log(BASE_ODDS)


def points_of(logit: Column) -> Column:
    """Points of a log-odds of default: the base points at the base odds, PDO per doubling."""
    return F.lit(OFFSET) - F.lit(FACTOR) * logit


def probability_of(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def weighted_cells(rows: DataFrame, target: str, columns: Sequence[Column]) -> DataFrame:
    """Reduce rows to distinct cells of the given columns with two weighted label rows each.

    Binned inputs repeat heavily, so the fit iterates over cells, not over loan-months; the
    likelihood is the same.
    """
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    labels = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("weight")),
    )
    return (
        rows.select(*named, (F.col(target) == 1).alias("y"))
        .groupBy(*names)
        .agg(F.count_if(F.col("y")).alias("pos"), F.count_if(~F.col("y")).alias("neg"))
        .select(*names, F.inline(labels))
        .where("weight > 0")
    )


def fit_ridge(cells: DataFrame, inputs: Sequence[Column], penalty: float = 1.0) -> LogisticFit:
    """Ridge logistic on weighted cells, which are written once as every step reads them."""
    return fit_newton(materialize(cells, "cells"), inputs, F.col("label"), F.col("weight"), penalty)


@dataclass(frozen=True)
class Scorecard:
    """Bins, coefficients and intercept; scoring is a plain column expression."""

    bins: dict[str, FeatureBins]
    coefficients: dict[str, float]
    intercept: float

    def logit(self) -> Column:
        total = F.lit(float(self.intercept))
        for feature, weight in self.coefficients.items():
            total = total + F.lit(float(weight)) * self.bins[feature].weight()
        return total

    def predict(self, rows: DataFrame, name: str = "scorecard_probability") -> DataFrame:
        return rows.withColumn(name, probability_of(self.logit()))

    def feature_points(self, feature: str) -> Column:
        """A feature's share of the points; shares add up to the score."""
        share = len(self.coefficients)
        logit = F.lit(self.coefficients[feature]) * self.bins[feature].weight() + self.intercept / share
        return F.lit(OFFSET / share) - F.lit(FACTOR) * logit

    def points(self, rows: DataFrame, name: str = "SCORE") -> DataFrame:
        return rows.withColumn(name, points_of(self.logit()))

    def bin_table(self, rows: DataFrame, target: str) -> DataFrame:
        """Count, event rate, weight of evidence, information value and points per bin (MOD3)."""
        table = woe_table(bin_counts(rows, target, {f: b.cuts for f, b in self.bins.items()}))
        weight = F.create_map(*(F.lit(x) for pair in self.coefficients.items() for x in pair))
        share = len(self.coefficients)
        logit = weight[F.col("feature")] * F.col("woe") + self.intercept / share
        return table.withColumn("points", F.lit(OFFSET / share) - F.lit(FACTOR) * logit)


def fit_scorecard(rows: DataFrame, target: str, features: Sequence[str] = FEATURES) -> Scorecard:
    bins = fit_bins(rows, target, features)
    weights = [bins[f].weight() for f in features]
    cells = weighted_cells(rows, target, weights)
    model = fit_ridge(cells, [F.col(f"c{i}") for i in range(len(features))])
    return Scorecard(bins, dict(zip(features, model.coefficients)), model.intercept)
