"""Discrete-time hazard: logistic on a cubic spline of loan age and scaled covariates (MOD5)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.models.newton import FitError, LogisticFit, fit_newton
from vintageline.models.scorecard import probability_of
from vintageline.settings import FEATURES
from vintageline.sources.snapshots import materialize

AGE = "SEASONING_MONTHS"
KNOTS = 5
DEGREE = 3
# From so many rows on, the steps of a fit begin where a fit of one row in ``FIRST_SHARE`` ends.
MANY_ROWS = 500_000
FIRST_SHARE = 16


def _cubic_bump(u: Column) -> Column:
    """Cubic B-spline on unit knots, non-zero on [0, 4)."""
    return (
        F.when((u < 0) | (u >= 4), 0.0)
        .when(u < 1, u * u * u / 6)
        .when(u < 2, ((12 - 3 * u) * u - 12) * u / 6 + 2 / 3)
        .when(u < 3, ((3 * u - 24) * u + 60) * u / 6 - 22 / 3)
        .otherwise((4 - u) * (4 - u) * (4 - u) / 6)
    )


def knot_place(value: Column, low: float, high: float, knots: int = KNOTS) -> Column:
    """Where a value lies among uniform knots over [low, high], in steps from the first; held at the ends."""
    step = (high - low) / (knots - 1) or 1.0
    held = F.least(F.greatest(value.cast("double"), F.lit(low)), F.lit(high))
    return (held - low) / step


# Pieces of the cubic bump on unit knots, as polynomials of the way from the piece's first knot.
_PIECES = np.array([[0, 0, 0, 1], [1, 3, 3, -3], [4, 0, -6, 3], [1, -3, 3, -1]]) / 6


def _cubics(weights: Sequence[float]) -> list[tuple[float, ...]]:
    """The weighted sum of the basis between each two knots, as coefficients of a cubic."""
    found = []
    for start in range(len(weights) - DEGREE + 1):
        pieces = ((start + DEGREE - i, w) for i, w in enumerate(weights))
        found.append(tuple(float(c) for c in sum(w * _PIECES[k] for k, w in pieces if 0 <= k <= DEGREE)))
    return found


def spline_basis(value: Column, low: float, high: float, knots: int = KNOTS) -> list[Column]:
    """Uniform cubic basis over [low, high], held constant outside, last function left out."""
    place = knot_place(value, low, high, knots)
    return [_cubic_bump(place + (DEGREE - i)) for i in range(knots + DEGREE - 2)]


@dataclass(frozen=True)
class HazardModel:
    medians: dict[str, float]
    age_range: tuple[float, float]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def _weighted(self, first: int, terms: list[Column]) -> Column:
        total = F.lit(0.0)
        for k, x in enumerate(terms, start=first):
            total = total + F.lit(self.coefficients[k] / self.deviations[k]) * (x - F.lit(self.means[k]))
        return total

    def age_logit(self, age: Column) -> Column:
        """The part of the log-odds that moves with loan age: between two knots, one cubic of the way from the first."""
        low, high = self.age_range
        place = knot_place(age, low, high)
        weights = [c / d for c, d in zip(self.coefficients, self.deviations[: KNOTS + DEGREE - 2])]
        shift = sum(w * m for w, m in zip(weights, self.means))
        between = None
        for start, (c0, c1, c2, c3) in enumerate(_cubics(weights)):
            x = place - float(start)
            cubic = ((c3 * x + c2) * x + c1) * x + (c0 - shift)
            between = F.when(place < start + 1.0, cubic) if between is None else between.when(place < start + 1.0, cubic)
        return between.otherwise(cubic)

    def covariate_logit(self) -> Column:
        """Intercept and the part that comes from the row's other features."""
        others = [filled(name, self.medians) for name in self.medians if name != AGE]
        return F.lit(self.intercept) + self._weighted(len(self.coefficients) - len(others), others)

    def logit(self) -> Column:
        return self.covariate_logit() + self.age_logit(filled(AGE, self.medians))

    def predict(self, rows: DataFrame, name: str = "hazard_probability") -> DataFrame:
        return rows.withColumn(name, probability_of(self.logit()))


def filled(name: str, medians: dict[str, float]) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(medians[name]))


def design(medians: dict[str, float], age_range: tuple[float, float]) -> list[Column]:
    """Spline terms of the age, then the other features with medians for missing values."""
    terms = spline_basis(filled(AGE, medians), *age_range)
    return terms + [filled(name, medians) for name in medians if name != AGE]


def _median(name: str) -> Column:
    return F.percentile_approx(F.col(name).cast("double"), 0.5, 100_000).alias(name)


def feature_medians(rows: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Medians of all features in one pass; 0 for a feature without a value."""
    found = rows.agg(*(_median(f) for f in features)).first()
    return {f: float(found[f] or 0.0) for f in features}


def fit_hazard(rows: DataFrame, target: str, features: Sequence[str] = FEATURES) -> HazardModel:
    return fit_hazards(rows, (target,), features)[0]


def fit_hazards(rows: DataFrame, targets: Sequence[str], features: Sequence[str] = FEATURES) -> list[HazardModel]:
    """One hazard per target, all on the same rows, whose terms are made and written once for all of them."""
    if AGE not in features:
        raise ValueError(f"hazard features must include {AGE}")
    found = rows.agg(
        *(_median(f) for f in features), F.min(AGE).alias("_low"), F.max(AGE).alias("_high")
    ).first()
    medians = {f: float(found[f] or 0.0) for f in features}
    age_range = (float(found["_low"]), float(found["_high"]))
    terms = design(medians, age_range)
    names, labels = [f"t{i}" for i in range(len(terms))], [f"label{i}" for i in range(len(targets))]
    data = rows.select(
        *(F.col(t).cast("double").alias(n) for t, n in zip(targets, labels)), *(t.alias(n) for t, n in zip(terms, names))
    )
    moments = data.agg(
        F.count(F.lit(1)), *(F.avg(n) for n in names), *(F.stddev_pop(n) for n in names)
    ).first()
    count, means, spreads = moments[0], moments[1 : 1 + len(names)], moments[1 + len(names) :]
    deviations = [d or 1.0 for d in spreads]
    scaled = [(F.col(n) - m) / d for n, m, d in zip(names, means, deviations)]
    # The terms are written once, as every step of the fits reads them.
    stored = materialize(data.select(*labels, *(x.alias(n) for x, n in zip(scaled, names))), "hazard-terms")
    first = None
    if count >= MANY_ROWS:
        share = F.pmod(F.xxhash64(*names), F.lit(FIRST_SHARE)) == 0
        first = materialize(stored.where(share), "hazard-first")
    models = []
    for label in labels:
        model = _fit_from(first, stored, [F.col(n) for n in names], F.col(label))
        models.append(
            HazardModel(medians, age_range, tuple(means), tuple(deviations), model.coefficients, model.intercept)
        )
    return models


def _fit_from(first: DataFrame | None, stored: DataFrame, terms: list[Column], label: Column) -> LogisticFit:
    """The fit of all rows, whose steps begin where those of ``first`` end, so that few of them read all rows."""
    if first is not None:
        try:
            return fit_newton(stored, terms, label, start=fit_newton(first, terms, label))
        except FitError:
            # From zero, as without the first rows.
            pass
    return fit_newton(stored, terms, label)
