"""Exact Shapley values of boosted trees against a reference row.

A feature set's worth is the log-odds of a row that takes these features from the row in question and the others from
the reference. Along the path to a leaf each feature is met by the row, by the reference, by both or by neither. With
neither, no feature set reaches the leaf. Otherwise those sets do that hold all ``a`` features that only the row
meets and none of the ``b`` that only the reference meets, so the leaf's value is shared out by two fractions:
(a-1)! b! / (a+b)! to each of the former, -a! (b-1)! / (a+b)! to each of the latter. So the values over all sets
of features are exact without going through the sets. Contributions and the reference's log-odds add up to the row's.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Mapping
from math import factorial

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.models.boosting import BoostedModel, Tree

# What the tasks run travels by value, so workers need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Reference = Mapping[str, float | None]


def median_row(rows: DataFrame, model: BoostedModel) -> dict[str, float | None]:
    """The median of each of the model's features, from one pass; NULL for a feature without values."""
    return rows.agg(
        *(F.percentile_approx(F.col(f).cast("double"), 0.5, 10_000).alias(f) for f in model.features)
    ).first().asDict()


def reference_bins(model: BoostedModel, reference: Reference) -> list[int]:
    """Bin of the reference in each feature, -1 where it has no value."""
    values = [reference[f] for f in model.features]
    return [-1 if v is None else bisect_right(model.cuts[f], v) for f, v in zip(model.features, values)]


def leaf_rules(tree: Tree, sizes: list[int]) -> list[tuple[float, dict[int, np.ndarray]]]:
    """Per leaf its value and, for each feature on the way, which bins lead there; the missing bin comes first."""
    found = []
    open_nodes: list[tuple[int, dict[int, np.ndarray]]] = [(0, {})]
    while open_nodes:
        node, rules = open_nodes.pop()
        feature = tree.feature[node]
        if feature < 0:
            found.append((tree.value[node], rules))
            continue
        goes_left = np.arange(-1, sizes[feature]) <= tree.bin[node]
        goes_left[0] = tree.missing_left[node]
        for child, side in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            open_nodes.append((child, rules | {feature: rules.get(feature, True) & side}))
    return found


def shares(features: int) -> tuple[np.ndarray, np.ndarray]:
    """The two fractions of a leaf's value by a and b; 0 where nobody would get them."""
    gain, loss = np.zeros((2, features + 1, features + 1))
    for a in range(features + 1):
        for b in range(features + 1 - a):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


def contributions(model: BoostedModel, reference: Reference) -> Column:
    """Array of what each feature adds to the log-odds of a row against the reference, in the model's order.

    A map over Arrow batches. A missing value is a bin of its own, in rows as in the reference.
    """
    cuts = [np.array(model.cuts[f], float) for f in model.features]
    base = reference_bins(model, reference)
    leaves = [leaf for tree in model.trees for leaf in leaf_rules(tree, [len(c) + 1 for c in cuts])]
    gain, loss = shares(len(cuts))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def share_out(*columns):
        import numpy as np
        import pyarrow as pa

        size = len(columns[0])
        places = []
        for edge, column in zip(cuts, columns):
            x = column.to_numpy(zero_copy_only=False)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            places.append(np.where(missing, 0, 1 + np.searchsorted(edge, np.where(missing, 0, x), side="right")))
        total = np.zeros((size, len(cuts)))
        for value, rules in leaves:
            met = {f: rule[places[f]] for f, rule in rules.items()}
            by_row = [f for f, rule in rules.items() if not rule[base[f] + 1]]
            reached = np.ones(size, bool)
            for f in by_row:
                reached &= met[f]
            others = [f for f in rules if f not in by_row]
            only_base = np.zeros(size, np.int64)
            for f in others:
                only_base += ~met[f]
            for f in by_row:
                total[:, f] += value * reached * gain[len(by_row), only_base]
            for f in others:
                total[:, f] -= value * (reached & ~met[f]) * loss[len(by_row), only_base]
        edges = pa.array(np.arange(0, size * len(cuts) + 1, len(cuts), dtype=np.int32))
        return pa.ListArray.from_arrays(edges, pa.array(total.ravel()))

    return share_out(*(F.col(f).cast("double") for f in model.features))
