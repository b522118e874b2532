"""Boosted trees with directions (MOD6, MOD12), grown on histograms that Spark adds up.

Features are cut into bins once, rows are reduced to distinct cells of bins with their event counts, and each level of
a tree is one pass over the cells: tasks add gradient, hessian and rows per (node, feature, bin), a shuffle of these
sums follows, and the driver, which holds at most nodes x features x bins numbers, picks the splits. Scores of the
cells are carried along and stored every ``KEEP_TREES`` trees, so a pass walks few trees and lost executors cost little.

A feature with a direction only takes splits whose leaf values follow it; the middle of the two values then bounds all
values below, on either side, so that no later split can turn the order round. A missing value goes to the side that
gains more.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.models.binning import bin_index, quantile_cuts
from vintageline.models.directions import directions_of
from vintageline.models.scorecard import probability_of
from vintageline.settings import FEATURES
from vintageline.sources.snapshots import materialize

# What the tasks run travels by value, so workers need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 24
DEPTH = 3
RATE = 0.25
BINS = 32
LEAST_ROWS = 50
RIDGE = 1.0
KEEP_TREES = 10
HISTOGRAM = "node int, feature int, bin int, rows double, gradient double, hessian double"


@dataclass(frozen=True)
class Tree:
    """Nodes from the root, 0: a row goes left when its bin is at most ``bin``, or missing and ``missing_left``.

    A leaf has feature -1 and a value."""

    feature: tuple[int, ...]
    bin: tuple[int, ...]
    missing_left: tuple[bool, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    gain: tuple[float, ...]


@dataclass(frozen=True)
class BoostedModel:
    features: tuple[str, ...]
    cuts: dict[str, tuple[float, ...]]
    trees: tuple[Tree, ...]
    intercept: float

    def logit(self) -> Column:
        """Log-odds of a row, walked for a whole Arrow batch at a time."""
        cuts = [np.array(self.cuts[f]) for f in self.features]
        trees, start = [_arrays(t) for t in self.trees], self.intercept

        @F.arrow_udf(T.DoubleType())
        def walk(*columns):
            import numpy as np
            import pyarrow as pa

            bins = []
            for edge, column in zip(cuts, columns):
                x = column.to_numpy(zero_copy_only=False)
                missing = column.is_null().to_numpy(zero_copy_only=False)
                bins.append(np.where(missing, -1, np.searchsorted(edge, np.where(missing, 0, x), side="right")))
            bins = np.column_stack(bins)
            total, rows = np.full(len(bins), start), np.arange(len(bins))
            for feature, cut, missing_left, left, right, value in trees:
                node = np.zeros(len(bins), np.int64)
                while (feature[node] >= 0).any():
                    b = bins[rows, np.maximum(feature[node], 0)]
                    goes_left = np.where(b < 0, missing_left[node], b <= cut[node])
                    node = np.where(feature[node] < 0, node, np.where(goes_left, left[node], right[node]))
                total += value[node]
            return pa.array(total)

        return walk(*(F.col(f).cast("double") for f in self.features))

    def predict(self, rows: DataFrame, name: str = "challenger_raw") -> DataFrame:
        return rows.withColumn(name, probability_of(self.logit()))

    def importance(self, rows: DataFrame) -> DataFrame:
        """Features by the loss that their splits took away (MOD12)."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    gains[self.features[feature]] += gain
        spark = rows.sparkSession
        return spark.createDataFrame(list(gains.items()), "feature string, importance double").orderBy(
            F.col("importance").desc()
        )


def _arrays(tree: Tree) -> tuple[np.ndarray, ...]:
    return tuple(
        np.array(x, t)
        for x, t in (
            (tree.feature, np.int64), (tree.bin, np.int64), (tree.missing_left, bool), (tree.left, np.int64),
            (tree.right, np.int64), (tree.value, float),
        )
    )


def binned_cells(rows: DataFrame, target: str, cuts: dict, features: Sequence[str]) -> DataFrame:
    """Distinct bin combinations c0.. with rows, events and the score so far, 0."""
    names = [f"c{i}" for i in range(len(features))]
    return (
        rows.select(
            *(bin_index(F.col(f), cuts[f]).cast("int").alias(n) for f, n in zip(features, names)),
            F.col(target).cast("double").alias("y"),
        )
        .groupBy(*names)
        .agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("y").alias("events"), F.lit(0.0).alias("score"))
    )


def _scored(batch, width: int, trees: list, start: float):
    """Bins by feature, rows, events and score of a batch of cells under the trees not yet in its score column."""
    bins = [batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(width)]
    rows, events, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rows", "events", "score"))
    return bins, rows, events, start + score + _added(bins, trees)


def _added(bins: list, trees: list) -> np.ndarray:
    total = np.zeros(len(bins[0]))
    for tree in trees:
        total += tree[5][_leaves(bins, tree)]
    return total


def _leaves(bins: list, tree: tuple) -> np.ndarray:
    """Leaf of every row; a node lies behind its parent, so one walk over the nodes takes all rows down."""
    node = np.zeros(len(bins[0]), np.int64)
    for at, (feature, cut, missing_left, left, right, _) in enumerate(zip(*tree)):
        if feature >= 0:
            b = bins[feature]
            goes_left = (b <= cut) if missing_left else (b <= cut) & (b >= 0)
            np.copyto(node, np.where(goes_left, left, right), where=node == at)
    return node


def level_histogram(cells: DataFrame, width: int, bins: int, start: float, trees: list, growing: tuple | None) -> DataFrame:
    """Rows, gradient and hessian of the log-loss per (node of the growing tree, feature, bin)."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        nodes = 1 if growing is None else len(growing[0])
        sums = np.zeros((3, nodes, width, bins + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            cell_bins, rows, events, score = _scored(batch, width, trees, start)
            p = 1 / (1 + np.exp(-score))
            values = (rows, rows * p - events, rows * p * (1 - p))
            node = 0 if growing is None else _leaves(cell_bins, growing) * (bins + 1)
            for i, b in enumerate(cell_bins):
                place = node + b + 1
                for table, value in zip(sums, values):
                    table[:, i] += np.bincount(place, value, nodes * (bins + 1)).reshape(nodes, bins + 1)
        for at in range(nodes):
            table = sums[:, at].reshape(3, -1)
            place = np.nonzero(table[0])[0]
            arrays = [np.full(len(place), at, np.int32), (place // (bins + 1)).astype(np.int32)]
            arrays += [(place % (bins + 1) - 1).astype(np.int32), *(t[place] for t in table)]
            names = ["node", "feature", "bin", "rows", "gradient", "hessian"]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    return cells.mapInArrow(add, HISTOGRAM).groupBy("node", "feature", "bin").agg(
        *(F.sum(c).alias(c) for c in ("rows", "gradient", "hessian"))
    )


def leaf_value(gradient: float, hessian: float, low: float, high: float) -> float:
    return min(max(-gradient / (hessian + RIDGE), low), high)


def loss_of(gradient: float, hessian: float, value: float) -> float:
    return gradient * value + (hessian + RIDGE) * value * value / 2


def best_split(
    tables: np.ndarray, directions: Sequence[int], low: float, high: float, least_rows: float = LEAST_ROWS
) -> tuple | None:
    """(gain, feature, bin, missing left, left value, right value) of the best split of a node.

    ``tables`` has rows, gradient and hessian by feature and bin, the missing bin first. Equal gains go to the earlier
    feature, bin and to missing left.
    """
    best = None
    for feature, direction in enumerate(directions):
        rows, gradient, hessian = tables[:, feature]
        totals = rows.sum(), gradient.sum(), hessian.sum()
        whole = loss_of(totals[1], totals[2], leaf_value(totals[1], totals[2], low, high))
        inner = np.cumsum(tables[:, feature, 1:], axis=1)
        for at in range(inner.shape[1] - 1):
            for missing_left in (True, False):
                part = inner[:, at] + (tables[:, feature, 0] if missing_left else 0)
                rest = np.array(totals) - part
                if min(part[0], rest[0]) < least_rows:
                    continue
                left, right = (leaf_value(x[1], x[2], low, high) for x in (part, rest))
                if direction * (right - left) < 0:
                    continue
                gain = whole - loss_of(part[1], part[2], left) - loss_of(rest[1], rest[2], right)
                if best is None or gain > best[0] + 1e-12:
                    best = (float(gain), feature, at, missing_left, float(left), float(right))
    return best if best and best[0] > 1e-12 else None


def _tables(rows: list, width: int, bins: int) -> dict[int, np.ndarray]:
    found: dict[int, np.ndarray] = {}
    for r in rows:
        table = found.setdefault(r["node"], np.zeros((3, width, bins + 1)))
        table[:, r["feature"], r["bin"] + 1] = r["rows"], r["gradient"], r["hessian"]
    return found


def _grown(cells: DataFrame, bins: int, start: float, trees: list, directions, depth: int, rate: float) -> Tree:
    feature, cut, missing, left, right, value, gain = [-1], [-1], [False], [-1], [-1], [0.0], [0.0]
    bounds = [(-math.inf, math.inf)]
    open_nodes, width = [0], len(directions)

    def tree() -> Tree:
        return Tree(*(tuple(x) for x in (feature, cut, missing, left, right, value, gain)))

    for level in range(depth):
        growing = _arrays(tree()) if level else None
        tables = _tables(level_histogram(cells, width, bins, start, trees, growing).collect(), width, bins)
        following = []
        for node in open_nodes:
            found = best_split(tables[node], directions, *bounds[node]) if node in tables else None
            if level == 0 and found is None:
                totals = tables[0][:, 0].sum(axis=1)
                value[0] = float(rate * leaf_value(totals[1], totals[2], *bounds[0]))
            if found is None:
                continue
            gain[node], feature[node], cut[node], missing[node], low_side, high_side = found
            low, high = bounds[node]
            middle, direction = (low_side + high_side) / 2, directions[feature[node]]
            sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}
            left[node], right[node] = len(feature), len(feature) + 1
            for side, side_value in zip(sides[direction], (low_side, high_side)):
                following.append(len(feature))
                for column, fresh in zip((feature, cut, missing, left, right, gain), (-1, -1, False, -1, -1, 0.0)):
                    column.append(fresh)
                value.append(rate * side_value)
                bounds.append(side)
        open_nodes = following
        if not open_nodes:
            break
    return tree()


def fit_boosted(
    rows: DataFrame,
    target: str,
    features: Sequence[str] = FEATURES,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    bins: int = BINS,
) -> BoostedModel:
    directions = directions_of(features) if set(features) >= set(FEATURES) else tuple(0 for _ in features)
    return fit_boosted_directed(rows, target, features, directions, trees, depth, rate, bins)


def fit_boosted_directed(
    rows: DataFrame, target: str, features: Sequence[str], directions: Sequence[int],
    trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
) -> BoostedModel:
    """Boosted trees whose score moves with ``directions`` (1, -1 or 0 for each feature)."""
    cuts = quantile_cuts(rows, features, bins)
    widest = max(len(c) for c in cuts.values()) + 1
    cells = materialize(binned_cells(rows, target, cuts, features), "boost-cells")
    count, events = cells.agg(F.sum("rows"), F.sum("events")).first()
    if not count or events in (0, count):
        raise ValueError("boosting needs rows of both classes")
    start = math.log(events / (count - events))
    grown: list[Tree] = []
    pending: list[tuple] = []
    for number in range(trees):
        tree = _grown(cells, widest, start, pending, directions, depth, rate)
        if tree.feature == (-1,):
            break
        grown.append(tree)
        pending.append(_arrays(tree))
        if len(pending) == KEEP_TREES and number + 1 < trees:
            cells, pending = materialize(with_scores(cells, len(features), pending), "boost-cells"), []
    return BoostedModel(tuple(features), cuts, tuple(grown), start)


def with_scores(cells: DataFrame, width: int, trees: list) -> DataFrame:
    """Cells with the trees' values added to their score."""
    schema = cells.schema

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                score = _scored(batch, width, trees, 0.0)[3]
                columns = [pa.array(score) if n == "score" else batch.column(n) for n in schema.fieldNames()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return cells.mapInArrow(add, schema)
