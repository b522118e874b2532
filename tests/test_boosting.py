"""Boosted trees and Newton fits."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintageline.models.boosting import Tree, _arrays, _leaves, best_split, fit_boosted_directed
from vintageline.models.challenger import calibrate
from vintageline.models.newton import FitError, fit_newton
from vintageline.models.scorecard import probability_of
from vintageline.models.shapley import contributions, median_row
from vintageline.models.store import load_models, store_models
from vintageline.portfolio.reasons import boosted_reasons
from vintageline.validation.metrics import auc


@pytest.fixture(scope="module")
def crossed(spark):
    """The event follows the exclusive or of two features, which no sum of single features can tell."""
    chance = random.Random(5)
    rows = []
    for _ in range(6000):
        a, b, c = chance.random(), chance.random(), chance.random()
        p = 0.9 if (a > 0.5) != (b > 0.5) else 0.1
        rows.append((a, b if chance.random() > 0.05 else None, c, int(chance.random() < p)))
    return spark.createDataFrame(rows, "a double, b double, c double, y int").cache()


def test_an_interaction_is_learned(crossed):
    model = fit_boosted_directed(crossed, "y", ("a", "b", "c"), (0, 0, 0), trees=12, depth=2, rate=0.5)
    scored = model.predict(crossed)
    assert auc(scored, "y", "challenger_raw").first().auc > 0.85
    ranked = [r.feature for r in model.importance(crossed).collect()]
    assert ranked[-1] == "c"


def test_directions_hold_everywhere(spark, crossed):
    model = fit_boosted_directed(crossed, "y", ("a", "b", "c"), (1, -1, 0), trees=12, depth=3, rate=0.5)
    grid = spark.range(21).select((F.col("id") / 20).alias("a"))
    others = spark.createDataFrame([(b, c) for b in (0.0, 0.3, 0.7, None) for c in (0.1, 0.9)], "b double, c double")
    by_rest = {}
    for row in grid.crossJoin(others).withColumn("z", model.logit()).orderBy("a").collect():
        by_rest.setdefault((row.b, row.c), []).append(row.z)
    assert all(x <= y + 1e-12 for line in by_rest.values() for x, y in zip(line, line[1:]))


def test_a_split_is_the_best_of_all():
    tables = np.zeros((3, 2, 5))
    tables[0], tables[2] = 100.0, 20.0
    tables[1, 0] = [0, 5, -5, 5, -5]
    tables[1, 1] = [0, -10, -10, 10, 10]
    gain, feature, at, missing_left, left, right = best_split(tables, (0, 0), -9, 9)
    assert (feature, at) == (1, 1) and left > 0 > right and gain > 0
    assert best_split(tables, (0, 1), -9, 9)[1] == 0
    assert best_split(tables, (0, 0), -9, 9, least_rows=300) is None


def test_boosted_models_are_stored_and_calibrated(spark, crossed, folder):
    model = fit_boosted_directed(crossed, "y", ("a", "b", "c"), (0, 0, 0), trees=4, depth=2)
    calibrated = calibrate(model, crossed, "y")
    store_models(spark, {"raw": model, "challenger": calibrated}, folder)
    again = load_models(spark, folder)
    assert again["raw"] == model and again["challenger"] == calibrated
    mean = calibrated.predict(crossed).agg(F.avg("challenger_probability"), F.avg("y")).first()
    assert mean[0] == pytest.approx(mean[1], abs=2e-3)


def test_one_class_cannot_be_boosted(crossed):
    with pytest.raises(ValueError):
        fit_boosted_directed(crossed.where("y = 1"), "y", ("a",), (0,))


def test_newton_solves_the_score_equations(crossed):
    terms = [F.coalesce("b", F.lit(0.5)), F.col("a") * 3 - 1]
    fit = fit_newton(crossed, terms, F.col("y"), F.lit(2.0), penalty=5.0)
    p = probability_of(F.lit(fit.intercept) + sum(F.lit(c) * t for c, t in zip(fit.coefficients, terms)))
    left = crossed.agg(F.sum(2 * (F.col("y") - p)), *(F.sum(2 * (F.col("y") - p) * t) for t in terms)).first()
    assert np.allclose(left, [0, *(5.0 * c for c in fit.coefficients)], atol=1e-4)
    assert fit.steps < 10


def test_newton_refuses_what_has_no_solution(spark, crossed):
    with pytest.raises(FitError):
        fit_newton(crossed.limit(0), [F.col("a")], F.col("y"))


def test_contributions_add_up_and_equal_all_orders(spark, crossed):
    """Against the average over all orders in which features can come in, by the model's own log-odds."""
    model = fit_boosted_directed(crossed, "y", ("a", "b", "c"), (0, 0, 0), trees=6, depth=3, rate=0.5)
    reference = median_row(crossed, model)
    given = [(k, a, b, c) for k, (a, b, c) in enumerate([(0.1, 0.9, 0.5), (0.7, None, 0.2), (None, None, None), (0.6, 0.4, 0.9)])]
    shape = "k int, a double, b double, c double"
    found = spark.createDataFrame(given, shape).select("k", contributions(model, reference).alias("parts")).collect()
    mixes = [
        (k * 8 + s, *(x if s >> i & 1 else reference[f] for i, (f, x) in enumerate(zip("abc", values))))
        for k, *values in given for s in range(8)
    ]
    worth = dict(spark.createDataFrame(mixes, shape).select("k", model.logit()).collect())
    for k, parts in found:
        expected = [0.0] * 3
        for order in permutations(range(3)):
            held = 0
            for i in order:
                expected[i] += (worth[k * 8 + (held | 1 << i)] - worth[k * 8 + held]) / 6
                held |= 1 << i
        assert list(parts) == pytest.approx(expected)
        assert sum(parts) == pytest.approx(worth[k * 8 + 7] - worth[k * 8])


def test_reasons_of_trees_are_ranked(spark, crossed):
    model = fit_boosted_directed(crossed, "y", ("a", "b", "c"), (0, 0, 0), trees=6, depth=3, rate=0.5)
    reference = {"a": 0.1, "b": 0.1, "c": 0.5}
    rows = spark.createDataFrame([(1, 0.9, 0.1, 0.5), (2, 0.1, 0.1, 0.5), (3, None, None, None)], "k int, a double, b double, c double")
    calibrated = calibrate(model, crossed, "y")
    found = boosted_reasons(rows, calibrated, reference, ["k"]).where("k < 3").collect()
    assert [(r.k, r["rank"], r.feature) for r in found] == [(1, 1, "a")]
    assert boosted_reasons(rows.where("k > 3"), model, reference, ["k"]).count() == 0


def test_a_walk_over_the_nodes_finds_every_leaf():
    rng = np.random.default_rng(3)
    bins = [rng.integers(-1, 6, 500) for _ in range(3)]
    tree = Tree((1, 0, 2, -1, -1, -1, -1), (2, 1, 4, -1, -1, -1, -1), (False, True, True) + (False,) * 4,
                (1, 3, 5) + (-1,) * 4, (2, 4, 6) + (-1,) * 4, (0.0,) * 7, (0.0,) * 7)
    expected = []
    for row in zip(*bins):
        at = 0
        while tree.feature[at] >= 0:
            b = row[tree.feature[at]]
            left = tree.missing_left[at] if b < 0 else b <= tree.bin[at]
            at = tree.left[at] if left else tree.right[at]
        expected.append(at)
    assert _leaves(bins, _arrays(tree)).tolist() == expected
