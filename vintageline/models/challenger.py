"""Challengers with sigmoid calibration (MOD6, MOD7, MOD8, MOD12).

The challenger is a monotone boosted model (``boosting``). The step model here is its additive alternative, quicker
to fit and to read: a logistic model on threshold indicators, monotone as the signs of its steps are bounded, but
without interactions. Both keep the same contract: the sweep check has to pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.models.binning import bin_index, quantile_cuts
from vintageline.models.boosting import BoostedModel
from vintageline.models.directions import directions_of
from vintageline.models.newton import MOST_STEPS, FitError, signed_minimum
from vintageline.models.scorecard import fit_ridge, probability_of
from vintageline.settings import FEATURES, RISK_DIRECTION
from vintageline.sources.snapshots import materialize

CHALLENGER_BINS = 20


@dataclass(frozen=True)
class StepModel:
    """Per feature: cuts, the step taken at each cut, and the step of a missing value."""

    cuts: dict[str, tuple[float, ...]]
    steps: dict[str, tuple[float, ...]]
    missing: dict[str, float]
    intercept: float

    def contribution(self, feature: str) -> Column:
        level, levels = 0.0, [0.0]
        for step in self.steps[feature]:
            level += step
            levels.append(level)
        value = F.lit(levels[-1])
        for cut, below in reversed(list(zip(self.cuts[feature], levels))):
            value = F.when(F.col(feature) < cut, F.lit(below)).otherwise(value)
        return F.when(F.col(feature).isNull(), F.lit(self.missing[feature])).otherwise(value)

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for feature in self.cuts:
            total = total + self.contribution(feature)
        return total

    def predict(self, rows: DataFrame, name: str = "challenger_raw") -> DataFrame:
        return rows.withColumn(name, probability_of(self.logit()))

    def importance(self, rows: DataFrame) -> DataFrame:
        """Features by how far their contribution moves the log-odds, as a standard deviation (MOD12)."""
        spread = F.array(
            *(
                F.struct(F.lit(f).alias("feature"), F.stddev_pop(self.contribution(f)).alias("importance"))
                for f in self.cuts
            )
        )
        return rows.agg(spread.alias("s")).select(F.inline("s")).orderBy(F.col("importance").desc())


def step_cells(rows: DataFrame, target: str, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Distinct bin combinations c0.. with their events ``pos`` and non-events ``neg``."""
    names = [f"c{i}" for i in range(len(cuts))]
    event = F.col(target) == 1
    return (
        rows.select(*(bin_index(F.col(f), c).cast("int").alias(n) for (f, c), n in zip(cuts.items(), names)), event.alias("y"))
        .groupBy(*names)
        .agg(F.count_if(F.col("y")).cast("double").alias("pos"), F.count_if(~F.col("y")).cast("double").alias("neg"))
    )


def level_sums(cells: DataFrame, levels: Sequence[np.ndarray], start: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-loss, scores and information of a sum of one level per feature, over all cells.

    ``levels`` has the log-odds of each bin by feature, the missing bin first. The places of the scores and of the
    information are the bins of all features, one feature after the other. A pass counts each pair of features by
    bins, so it costs pairs of features a cell, whatever the number of bins.
    """
    sizes = [len(x) for x in levels]
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])

    def add(batches):
        import numpy as np
        import pyarrow as pa

        loss, score, information = 0.0, np.zeros(total), np.zeros((total, total))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = [batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(np.int64) + 1 for i in range(len(sizes))]
            pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg"))
            z = start + sum(x[b] for x, b in zip(levels, bins))
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            loss += float(np.sum((pos + neg) * np.logaddexp(0, z) - pos * z))
            left, weight = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
            for i, b in enumerate(bins):
                score[first[i] : first[i + 1]] += np.bincount(b, left, sizes[i])
                for j in range(i, len(bins)):
                    both = np.bincount(b * sizes[j] + bins[j], weight, sizes[i] * sizes[j])
                    information[first[i] : first[i + 1], first[j] : first[j + 1]] += both.reshape(sizes[i], sizes[j])
        found = np.concatenate([[loss], score, information.ravel()])
        place = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(found[place])], names=["place", "value"])

    sums = cells.mapInArrow(add, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    result = np.zeros(1 + total + total * total)
    # Bounded by the square of the number of bins of all features.
    for row in sums.collect():
        result[row.place] = row.value
    information = result[1 + total :].reshape(total, total)
    return float(result[0]), result[1 : 1 + total], np.triu(information) + np.triu(information, 1).T


def fit_steps(
    rows: DataFrame,
    target: str,
    features: Sequence[str] = FEATURES,
    bins: int = CHALLENGER_BINS,
    penalty: float = 1.0,
    tolerance: float = 1e-9,
) -> StepModel:
    """Fit all steps jointly; a step against a feature's direction is held at zero.

    Newton steps under these signs: each is one pass over the stored cells, and the best move under the signs is found
    on the driver from the sums by bin. ``penalty`` / 2 times the squared steps is added to the log-loss.
    """
    directions = directions_of(features)
    cuts = quantile_cuts(rows, features, bins)
    cells = materialize(step_cells(rows, target, cuts), "cells")
    signs, blocks = [0], []
    for feature, direction in zip(features, directions):
        steps = len(cuts[feature])
        # Of bins, the missing one first, to steps: one at each cut, then that of a missing value.
        block = np.zeros((steps + 2, steps + 1))
        block[0, steps] = 1.0
        for k in range(steps):
            block[k + 2 :, k] = 1.0
        blocks.append(block)
        signs += [direction] * steps + [0]
    width = len(signs)
    spread = np.zeros((sum(len(b) for b in blocks), width))
    row, column = 0, 1
    for block in blocks:
        spread[row : row + block.shape[0], column : column + block.shape[1]] = block
        row, column = row + block.shape[0], column + block.shape[1]
    # Each row has one bin of the first feature, whose sums give those of the intercept.
    spread[: len(blocks[0]), 0] = 1.0
    ends = np.cumsum([len(b) for b in blocks])[:-1]
    ridge, signs = np.diag([0.0] + [penalty] * (width - 1)), np.array(signs)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        levels = np.split(spread[:, 1:] @ beta[1:], ends)
        loss, score, information = level_sums(cells, levels, float(beta[0]))
        return loss + beta @ ridge @ beta / 2, spread.T @ score - ridge @ beta, spread.T @ information @ spread + ridge

    beta = np.zeros(width)
    loss, score, information = at(beta)
    # At zero every row has information 1 / 4.
    total = 4 * information[0, 0]
    if not total > 0:
        raise FitError("no rows to fit")
    for _ in range(MOST_STEPS):
        free = (signs == 0) | (beta != 0) | (signs * score > 0)
        if np.max(np.abs(score[free])) <= tolerance * total:
            break
        there, share = signed_minimum(information, information @ beta + score, signs), 1.0
        while True:
            # A whole step is taken as it is, so that steps held at zero are zero.
            tried = there if share == 1.0 else beta + share * (there - beta)
            found = at(tried)
            if found[0] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        beta, (loss, score, information) = tried, found
    else:
        raise FitError(f"not settled after {MOST_STEPS} steps")
    weights = iter(map(float, beta[1:]))
    steps, missing = {}, {}
    for feature in features:
        steps[feature] = tuple(next(weights) for _ in cuts[feature])
        missing[feature] = next(weights)
    return StepModel(dict(cuts), steps, missing, float(beta[0]))


@dataclass(frozen=True)
class Calibrated:
    """A frozen model and the sigmoid fitted over its probability."""

    model: StepModel | BoostedModel
    slope: float
    intercept: float

    def probability(self) -> Column:
        raw = probability_of(self.model.logit())
        return probability_of(F.lit(self.slope) * raw + F.lit(self.intercept))

    def predict(self, rows: DataFrame, name: str = "challenger_probability") -> DataFrame:
        return rows.withColumn(name, self.probability())


def platt_rows(rows: DataFrame, target: str, probability: Column) -> DataFrame:
    """Two weighted rows per distinct probability, with smoothed targets instead of 0 and 1."""
    cells = (
        rows.select(probability.alias("p"), (F.col(target) == 1).alias("y"))
        .groupBy("p")
        .agg(F.count_if(F.col("y")).alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    )
    totals = cells.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    hit = (F.col("all_pos") + 1) / (F.col("all_pos") + 2)
    miss = 1 / (F.col("all_neg") + 2)
    toward_one = F.col("pos") * hit + F.col("neg") * miss
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), toward_one.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("pos") + F.col("neg") - toward_one).alias("weight")),
    )
    return (
        cells.withColumns({c: totals.select(c).scalar() for c in totals.columns})
        .select("p", F.inline(both))
    )


def calibrate(model: StepModel | BoostedModel, rows: DataFrame, target: str) -> Calibrated:
    """Sigmoid over the frozen model's probability, fitted on rows it was not trained on (MOD7)."""
    cells = platt_rows(rows, target, probability_of(model.logit()))
    fitted = fit_ridge(cells, [F.col("p")], penalty=0.0)
    return Calibrated(model, fitted.coefficients[0], fitted.intercept)


def selected_model(lower: Column) -> Column:
    """The challenger ships only when the whole interval of its gain is above zero (MOD8)."""
    return F.when(lower > 0, "challenger").otherwise("scorecard")


def beats_baseline(lower: Column) -> Column:
    return F.coalesce(lower > 0, F.lit(False))


def feature_ranges(rows: DataFrame, features: Mapping[str, int] = RISK_DIRECTION) -> DataFrame:
    """Observed range of the constrained drivers, to set sweep bounds against."""
    cells = F.array(
        *(F.struct(F.lit(f).alias("feature"), F.min(f).cast("double").alias("low"), F.max(f).cast("double").alias("high")) for f in features)
    )
    return rows.agg(cells.alias("c")).select(F.inline("c"))
