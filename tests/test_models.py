import itertools
import math
from collections import Counter
from datetime import date
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintageline.functions.ordered import dense_index, totals_below
from vintageline.models.baseline import fit_marginal_rates, require_usable
from vintageline.models.binning import MISSING, bin_counts, fit_bins, optimal_bins, weight_of
from vintageline.models.challenger import Calibrated, StepModel, calibrate, fit_steps
from vintageline.models.directions import directions_of
from vintageline.models.frame import feature_list_hash, loan_sample, require_both_classes, require_no_outcomes
from vintageline.models.hazard import fit_hazard, spline_basis
from vintageline.models.newton import signed_minimum
from vintageline.models.scorecard import FACTOR, OFFSET, fit_scorecard
from vintageline.models.store import load_models, store_models
from vintageline.plans.training import record_evidence, train_baseline_models, train_challenger
from vintageline.portfolio.loss import loss_given_default, model_term_structure
from vintageline.portfolio.competing import CAUSES, competing_incidence, exit_next_month
from vintageline.portfolio.reporting import remaining_months
from vintageline.queries.model_queries import AGE_WEIGHTS, fixed_hazard, fixed_prepayment, fixed_scorecard
from vintageline.settings import FEATURES, RISK_DIRECTION, TARGET_12M
from vintageline.validation import bootstrap
from vintageline.validation.bootstrap import (
    PRIME,
    gini_differences,
    linear_hash,
    poisson_limits,
    require_interval,
)
from vintageline.validation.metrics import auc, calibration_by_quantile, ks_statistic
from vintageline.validation.stability import FLOOR, quantile_edges, stability_index
from vintageline.validation.monotone import (
    MonotonicityError,
    require_monotone,
    sweep_grid,
    sweep_report,
)

MEDIANS = {"CLASSIC_FICO": 720.0, "OLTV": 80.0, "DTI": 35.0, "CURRENT_LTV": 70.0, "SEASONING_MONTHS": 24.0,
           "UNRATE": 5.0, "MORTGAGE30US": 4.0}


@pytest.fixture(scope="module")
def rows(spark):
    """Loan rows whose labels follow a logit of the drivers, missing values included."""
    rng = random.Random(3)
    out = []
    for i in range(3000):
        fico, oltv, dti = rng.randint(560, 830), rng.randint(30, 110), rng.randint(5, 60)
        cltv = None if rng.random() < 0.2 else float(oltv * rng.uniform(0.5, 1.3))
        age = rng.randint(0, 60)
        logit = -1.2 - 0.012 * (fico - 700) + 0.02 * (oltv - 75) + 0.02 * (dti - 35) + 0.01 * ((cltv or 70) - 70)
        y = int(rng.random() < 1 / (1 + math.exp(-logit)))
        out.append((f"L{i // 3}", fico, oltv, dti, cltv, age, rng.uniform(3, 10), rng.uniform(2, 7), y))
    return spark.createDataFrame(
        out,
        "LOAN_ID string, CLASSIC_FICO int, OLTV int, DTI int, CURRENT_LTV double, SEASONING_MONTHS int, UNRATE double, "
        "MORTGAGE30US double, DEFAULT_IN_12M int",
    ).cache()


def test_baseline_arithmetic(spark):
    train = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0)], "SEASONING_MONTHS int, y int")
    model = fit_marginal_rates(train, "y", smoothing=2.0)
    asked = spark.createDataFrame([(1,), (2,), (99,)], "SEASONING_MONTHS int")
    got = {r.SEASONING_MONTHS: r.baseline_probability for r in model.predict(asked).collect()}
    assert got == {1: 0.75, 2: 0.25, 99: 0.5}
    with pytest.raises(ValueError):
        fit_marginal_rates(train, "y", smoothing=-1.0)
    for bad in ([(None, 1)], [(1, 2)], []):
        with pytest.raises(ValueError):
            require_usable(spark.createDataFrame(bad, "SEASONING_MONTHS int, y int"), "y")


@pytest.mark.parametrize("direction", [-1, 0, 1])
@pytest.mark.parametrize("seed", range(6))
def test_optimal_bins_beat_every_division(seed, direction):
    chance = random.Random(seed)
    counts = {k: (n := chance.choice([0, 3, 40, 100, 100]), chance.randint(0, n)) for k in range(8)}
    counts[7] = (90, 9)
    counts[MISSING] = (20, 5)
    cuts = [float(k) for k in range(1, 8)]
    rows, events = (sum(c[i] for c in counts.values()) for i in (0, 1))
    values = []
    for mask in itertools.product((0, 1), repeat=7):
        groups = [[0, 0]]
        for k in range(8):
            groups[-1][0] += counts[k][0]
            groups[-1][1] += counts[k][1]
            if k < 7 and mask[k]:
                groups.append([0, 0])
        rates = [e / n for n, e in groups if n]
        steps = [(b - a) * direction >= 0 for a, b in zip(rates, rates[1:])]
        if min(n for n, _ in groups) >= 30 and all(steps):
            values.append(sum(weight_of(n, e, rows, events)[1] for n, e in groups))
    found = optimal_bins(cuts, counts, 30, direction, rows, events)
    assert sum(weight_of(b.rows, b.events, rows, events)[1] for b in found) == pytest.approx(max(values))
    assert min(b.rows for b in found) >= 30 and found[-1].upper == math.inf
    assert sum(b.rows for b in found) == rows - 20


def test_too_few_rows_make_one_bin():
    assert [b.rows for b in optimal_bins([1.0], {0: (3, 1), 1: (4, 1)}, 30, 1, 7, 2)] == [7]
    assert optimal_bins([], {MISSING: (3, 1)}, 1, 1, 3, 1) == []


def test_fitted_bins_hold_their_constraints(rows):
    bins = fit_bins(rows, TARGET_12M)
    total = rows.count()
    table = {}
    for r in bin_counts(rows, TARGET_12M, {f: b.cuts for f, b in bins.items()}).collect():
        table.setdefault(r.feature, {})[r.bin] = (r.rows, r.events)
    assert MISSING in table["CURRENT_LTV"]
    for feature, direction in RISK_DIRECTION.items():
        inner = [table[feature][k] for k in sorted(table[feature]) if k != MISSING]
        rates = [e / n for n, e in inner]
        assert all((b - a) * direction >= 0 for a, b in zip(rates, rates[1:]))
        assert min(n for n, _ in inner) >= 0.03 * total * 0.8 and len(inner) > 2
    with pytest.raises(ValueError):
        fit_bins(rows, TARGET_12M, ("OLTV", "DTI"))


def test_scorecard_ranks_and_scales(rows):
    card = fit_scorecard(rows, TARGET_12M)
    scored = card.points(card.predict(rows))
    assert auc(scored, TARGET_12M, "scorecard_probability").first().auc > 0.7
    p, s = scored.select("scorecard_probability", "SCORE").first()
    assert s == pytest.approx(OFFSET - FACTOR * math.log(p / (1 - p)))
    shares = scored.select((sum(card.feature_points(f) for f in FEATURES) - F.col("SCORE")).alias("d"))
    assert abs(shares.agg(F.max(F.abs("d"))).first()[0]) < 1e-6
    assert card.bin_table(rows, TARGET_12M).where("feature = 'DTI'").count() == len(card.bins["DTI"].woe)


def test_spline_basis_is_a_partition_of_unity(spark):
    ages = spark.createDataFrame([(float(a),) for a in range(-5, 70)], "a double")
    terms = spline_basis(F.col("a"), 0.0, 48.0)
    got = ages.select("a", F.array(*terms).alias("b")).orderBy("a").collect()
    for r in got:
        assert all(-1e-12 <= b <= 2 / 3 + 1e-12 for b in r.b) and sum(r.b) <= 1 + 1e-9
    middle = next(r for r in got if r.a == 24.0)
    assert sum(middle.b) == pytest.approx(1.0)
    assert got[0].b == got[5].b and got[-1].b == next(r for r in got if r.a == 48.0).b


def test_hazard_fit_beats_chance(rows):
    model = fit_hazard(rows, TARGET_12M)
    assert auc(model.predict(rows), TARGET_12M, "hazard_probability").first().auc > 0.7
    with pytest.raises(ValueError):
        fit_hazard(rows, TARGET_12M, ("OLTV", "DTI"))


def test_challenger_is_monotone_and_calibrated(spark, rows):
    raw = fit_steps(rows, TARGET_12M)
    for feature, direction in RISK_DIRECTION.items():
        assert all(step * direction >= 0 for step in raw.steps[feature])
    calibrated = calibrate(raw, rows, TARGET_12M)
    report = require_monotone(sweep_report(sweep_grid(spark, MEDIANS), calibrated.probability()))
    assert len(report) == 4 and all(r.maximum_probability > r.minimum_probability for r in report)
    scored = calibrated.predict(rows)
    assert auc(scored, TARGET_12M, "challenger_probability").first().auc > 0.7
    means = scored.agg(F.avg("challenger_probability"), F.avg(TARGET_12M)).first()
    assert means[0] == pytest.approx(means[1], abs=0.01)
    ranked = [r.importance for r in raw.importance(rows).collect()]
    assert ranked == sorted(ranked, reverse=True)
    assert directions_of() == (-1, 1, 1, 1, 0, 0, 0)


def test_steps_settle_under_their_signs(spark, rows):
    model = fit_steps(rows, TARGET_12M)
    means = model.predict(rows).agg(F.avg("challenger_raw"), F.avg(TARGET_12M)).first()
    assert means[0] == pytest.approx(means[1], abs=1e-9)
    p, y = F.col("challenger_raw"), F.col(TARGET_12M)
    for feature in FEATURES:
        direction = RISK_DIRECTION.get(feature, 0)
        scored = model.predict(rows)
        terms = [F.col(feature) >= F.lit(c) for c in model.cuts[feature]] + [F.col(feature).isNull()]
        found = scored.agg(*(F.coalesce(F.sum(F.when(t, y - p)), F.lit(0.0)) for t in terms)).first()
        for at, (score, step) in enumerate(zip(found, (*model.steps[feature], model.missing[feature]))):
            held = step == 0 and direction and at < len(model.steps[feature])
            pull = score - step
            assert pull * direction <= 1e-4 if held else abs(pull) < 1e-4


def test_signed_minimum_equals_a_search_of_all_sets():
    draw = np.random.default_rng(5)
    for _ in range(40):
        half = draw.normal(size=(9, 6))
        matrix, pull, signs = half.T @ half + np.eye(6), draw.normal(size=6) * 3, draw.integers(-1, 2, 6)
        best = math.inf
        for kept in itertools.product((False, True), repeat=6):
            loose = np.array(kept) | (signs == 0)
            x = np.zeros(6)
            if loose.any():
                x[loose] = np.linalg.solve(matrix[np.ix_(loose, loose)], pull[loose])
            if (signs * x >= 0).all():
                best = min(best, x @ matrix @ x / 2 - pull @ x)
        got = signed_minimum(matrix, pull, signs)
        assert (signs * got >= 0).all() and got @ matrix @ got / 2 - pull @ got == pytest.approx(best, abs=1e-9)


def test_inverted_model_is_rejected(spark):
    wrong = StepModel({f: (700.0,) for f in FEATURES}, {f: (1.0,) for f in FEATURES}, dict.fromkeys(FEATURES, 0.0), 0.0)
    with pytest.raises(MonotonicityError, match="CLASSIC_FICO"):
        require_monotone(sweep_report(sweep_grid(spark, MEDIANS), Calibrated(wrong, 1.0, 0.0).probability()))


def test_sweep_arguments(spark):
    with pytest.raises(ValueError):
        sweep_grid(spark, MEDIANS, points=1)
    with pytest.raises(ValueError):
        sweep_grid(spark, {"OLTV": 1.0})
    with pytest.raises(ValueError):
        sweep_grid(spark, MEDIANS, {**{f: (0.0, 1.0) for f in RISK_DIRECTION}, "DTI": (5.0, 5.0)})


def reference_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("spread", [1, 3, 40, 10_000])
def test_rank_metrics_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    data = [(g, rng.randrange(spread) / 7, rng.randrange(2)) for g in "ab" for _ in range(300)] + [("c", 0.5, 1)]
    frame = spark.createDataFrame(data, "g string, s double, y int").repartition(7)
    for r in auc(frame, "y", "s", ("g",)).collect():
        want = reference_auc([(s, y) for g, s, y in data if g == r.g])
        assert (r.auc is None) if want is None else r.auc == pytest.approx(want, abs=1e-12)
    for r in ks_statistic(frame, "y", "s", ("g",)).collect():
        mine = [(s, y) for g, s, y in data if g == r.g]
        events, others = [s for s, y in mine if y], [s for s, y in mine if not y]
        gaps = [abs(sum(e <= t for e in events) / len(events) - sum(o <= t for o in others) / len(others)) for t, _ in mine]
        assert r.ks == pytest.approx(max(gaps))
    deciles = calibration_by_quantile(frame, "y", "s").collect()
    assert sum(r.rows for r in deciles) == len(data)


def test_totals_below_with_a_hot_value(spark):
    data = [(0.5, 1)] * 400 + [(i / 1000, 1) for i in range(600)]
    grouped = spark.createDataFrame(data, "v double, n int").groupBy("v").agg(F.sum("n").alias("n"))
    for r in totals_below(grouped, "v", ["n"]).collect():
        assert r.n_below == sum(1 for v, _ in data if v < r.v)


def test_dense_index_is_a_bijection(spark):
    keys = spark.range(500).selectExpr("concat('k', id % 321) AS k")
    got = sorted(r.idx for r in dense_index(keys, "k", 16).collect())
    assert got == list(range(321))


def bootstrap_rows(spark, loans=60):
    return spark.createDataFrame(
        [(f"L{i}", i % 2, float(i % 2), 0.5) for i in range(loans)], "LOAN_ID string, y int, good double, flat double"
    )


@pytest.mark.parametrize("portable", [True, False])
def test_bootstrap_of_a_perfect_candidate(spark, portable):
    rows = bootstrap_rows(spark)
    first = require_interval(rows, "y", "good", "flat", replicates=100, portable=portable)
    again = require_interval(rows, "y", "good", "flat", replicates=100, portable=portable)
    assert first == again
    assert (first.estimate, first.lower, first.upper, first.successful_replicates) == (1.0, 1.0, 1.0, 100)


@pytest.mark.parametrize("exact", [True, False])
def test_bootstrap_draws_vary(spark, exact):
    rng = random.Random(1)
    rows = spark.createDataFrame(
        [(f"L{i // 4}", rng.randrange(2), rng.random(), rng.random()) for i in range(400)],
        "LOAN_ID string, y int, a double, b double",
    )
    drawn = gini_differences(rows, "y", "a", "b", replicates=25, exact_draws=exact)
    got = {r.rep: r.difference for r in drawn.collect()}
    assert set(got) == set(range(26)) and len({round(v, 9) for v in got.values()}) > 20
    full = [(r.a, r.b, r.y) for r in rows.collect()]
    want = 2 * reference_auc([(a, y) for a, _, y in full]) - 2 * reference_auc([(b, y) for _, b, y in full])
    assert got[0] == pytest.approx(want)


def test_bootstrap_weights_are_poisson():
    rng = random.Random(4)
    loans = [rng.randrange(PRIME) for _ in range(20_000)]
    a, b = linear_hash(1, 2)
    weights = [sum((h * a + b) % PRIME >= limit for limit in poisson_limits()) for h in loans]
    for k in range(4):
        assert weights.count(k) / len(loans) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)


def test_bootstrap_hands_on_a_score_once_a_task(spark, monkeypatch):
    one_task = spark.range(0, 20_000, 1, 1).selectExpr(
        "string(id) AS loan", "double(id % 3) AS candidate", "double(id % 2) AS baseline", "int(id % 2) AS y", "1L AS n"
    )
    found = bootstrap._poisson_rows(one_task, 20, 1, False).collect()
    # Six pairs of candidate's score and label and two of the baseline's, in each replicate.
    assert len(found) == 8 * 21 and sum(r.w for r in found if r.rep == 0) == 40_000
    monkeypatch.setattr(bootstrap, "HELD_SCORES", 3)
    parts = Counter()
    for r in bootstrap._poisson_rows(one_task, 20, 1, False).collect():
        parts[r.model, r.score, r.y, r.rep] += r.w
    assert parts == {(r.model, r.score, r.y, r.rep): r.w for r in found}


def test_bootstrap_guards(spark):
    rows = bootstrap_rows(spark)
    with pytest.raises(ValueError, match="two loans"):
        require_interval(rows.withColumn("LOAN_ID", F.lit("X")), "y", "good", "flat", replicates=10)
    with pytest.raises(ValueError, match="both classes"):
        require_interval(rows.where("y = 1"), "y", "good", "flat", replicates=10)
    with pytest.raises(ValueError, match="too few"):
        require_interval(bootstrap_rows(spark, 2), "y", "good", "flat", replicates=12)
    for wrong in ({"replicates": 0}, {"alpha": 1.0}):
        with pytest.raises(ValueError):
            require_interval(rows, "y", "good", "flat", **wrong)


def test_stored_models_come_back_equal(spark, folder):
    steps = StepModel({"OLTV": (60.0, 80.0)}, {"OLTV": (0.1, 0.25)}, {"OLTV": -0.3}, -2.0)
    models = {
        "card": fixed_scorecard(),
        "hazard": fixed_hazard(),
        "steps": steps,
        "challenger": Calibrated(steps, 4.5, -3.1),
    }
    assert store_models(spark, models, f"{folder}/models", {"gold": 3}) == 0
    assert load_models(spark, f"{folder}/models") == models


def test_sample_keeps_whole_loans(spark):
    rows = spark.range(4000).selectExpr("concat('L', id % 400) AS LOAN_ID")
    for portable in (True, False):
        kept = loan_sample(rows, 10, 3, portable).groupBy("LOAN_ID").count().collect()
        assert 60 < len(kept) < 190 and {r["count"] for r in kept} == {10}
    for keep in (0, 11):
        with pytest.raises(ValueError):
            loan_sample(rows, 10, keep)


def test_guards():
    require_no_outcomes(FEATURES)
    with pytest.raises(ValueError, match="EXIT_TYPE"):
        require_no_outcomes([*FEATURES, "EXIT_TYPE"])
    assert feature_list_hash(("A", "B")) != feature_list_hash(("B", "A"))


def test_single_class_is_refused(spark):
    with pytest.raises(ValueError, match="single class"):
        require_both_classes(spark.createDataFrame([(1,)], "y int"), "y", "training")


def bump(u):
    if not 0 <= u < 4:
        return 0.0
    pieces = (u**3, -3 * u**3 + 12 * u**2 - 12 * u + 4, 3 * u**3 - 24 * u**2 + 60 * u - 44, (4 - u) ** 3)
    return pieces[int(u)] / 6


def monthly(cause, base, slope, age, dti):
    place = min(age, 60) / 15
    logit = base + slope * (dti - 30) + sum(w * bump(place + 3 - i) for i, w in enumerate(AGE_WEIGHTS[cause]))
    return 1 / (1 + math.exp(-logit))


@pytest.mark.parametrize("beside", [False, True])
def test_chained_pd_equals_the_walk(spark, beside):
    rows = spark.createDataFrame([(i, 5 * i, 10 + i, m) for i, m in enumerate((0, 1, 12, 30, 200))],
                                 "i int, SEASONING_MONTHS int, DTI int, REM_MONTHS int")
    competing = (fixed_prepayment(),) if beside else ()
    for r in model_term_structure(rows, fixed_hazard(), competing=competing).collect():
        staying, lost, near = 1.0, 0.0, 0.0
        for k in range(r.REM_MONTHS):
            h = monthly("default", -5.0, 0.02, r.SEASONING_MONTHS + k, r.DTI)
            o = monthly("prepaid", -4.0, -0.01, r.SEASONING_MONTHS + k, r.DTI) if beside else 0.0
            lost += staying * h
            staying *= 1 - h - o
            near = lost if k < 12 else near
        assert (r.PD_LIFETIME, r.PD_12M) == pytest.approx((lost, near))


def test_incidences_and_survival_add_up_to_one(spark):
    cells = [("a", 1, 100, 5, 10, 0, 0), ("a", 2, 80, 4, 0, 1, 3), ("a", 9, 2, 1, 1, 0, 0), ("a", 10, 5, 1, 0, 0, 0), ("b", 30, 4, 0, 0, 0, 0)]
    table = spark.createDataFrame(cells, "g string, age int, at_risk bigint, " + ", ".join(f"{c} bigint" for c in CAUSES))
    got = {(r.g, r.age): r for r in competing_incidence(table, 3, ["g"]).collect()}
    assert len(got) == 5
    for r in got.values():
        for name in ("horizon", "lifetime"):
            assert sum(r[f"{c}_{name}"] for c in ("survival", *CAUSES)) == pytest.approx(1)
    first = got["a", 1]
    assert first.default_horizon == pytest.approx(0.05 + 0.85 * 0.05)
    assert first.survival_lifetime == 0 and first.default_lifetime == pytest.approx(0.0925 + 0.85 * 0.9 * 0.5)
    assert got["b", 30].survival_lifetime == 1 and got["a", 10].default_horizon == pytest.approx(0.2)
    assert competing_incidence(table.limit(0), 3, ["g"]).count() == 0


def test_exits_are_told_where_the_next_month_is_known(spark):
    day = lambda m: date(2012, m, 1)
    rows = [("d", day(1), day(2), "default", 1), ("p", day(1), day(2), "prepaid", 0), ("e", day(1), day(3), "prepaid", 0),
            ("s", day(1), None, "right_censored", 0), ("n", day(1), None, "right_censored", None)]
    frame = spark.createDataFrame(rows, "LOAN_ID string, ACT_PERIOD date, EXIT_DATE date, EXIT_TYPE string, DEFAULT_NEXT_MONTH int")
    got = {r.LOAN_ID: r.EXIT_NEXT_MONTH for r in exit_next_month(frame).collect()}
    assert got == {"d": "default", "p": "prepaid", "e": "none", "s": "none", "n": None}


def test_lifetime_needs_the_months_left(spark):
    rows = spark.createDataFrame([(None, 360, 12), (5, 360, 12)], "REM_MONTHS int, ORIG_TERM int, LOAN_AGE int")
    assert [r[0] for r in rows.select(remaining_months(rows)).collect()] == [348, 5]
    with pytest.raises(ValueError, match="REM_MONTHS"):
        remaining_months(rows.select("LOAN_AGE"))


def test_lgd_falls_back_to_the_assumption(spark):
    rows = spark.createDataFrame([("a", 100.0, 10.0, 60.0), ("b", 100.0, None, None)],
                                 "s string, LAST_UPB double, FORECLOSURE_COSTS double, NET_SALES_PROCEEDS double")
    got = {r.s: (r.lgd, r.lgd_source) for r in loss_given_default(rows, ["s"]).collect()}
    assert got == {"a": (0.5, "empirical"), "b": (0.4, "assumed")}


def challenger_frame(rows):
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("out_of_time")), (F.abs(F.hash("LOAN_ID")) % 3) + 1)
    return rows.withColumns(
        {
            "MODELLING_SPLIT": split,
            "LABEL_OBSERVED_12M": F.lit(True),
            "ACT_PERIOD": F.lit("2015-01-01").cast("date"),
            "LAST_OBSERVED_DATE": F.lit("2016-01-01").cast("date"),
            "DEFAULT_NEXT_MONTH": F.col(TARGET_12M),
        }
    )


def test_training_runs(spark, rows, folder):
    frame = challenger_frame(rows)
    first = train_baseline_models(frame, 3, replicates=20)
    assert first.scorecard_beats_baseline and first.metrics["scorecard_auc"] > first.metrics["baseline_auc"]
    kinds = {(k, key) for _, k, key, _ in first.evidence}
    assert {("source", "gold_version"), ("features", "hash"), ("metric", "hazard_auc"), ("splits", "rows_train")} <= kinds
    second = train_challenger(frame, 3, replicates=20)
    for run in (first, second):
        record_evidence(spark, run.evidence, f"{folder}/evidence")
    stored = spark.read.parquet(f"{folder}/evidence")
    assert stored.select("run_id").distinct().count() == 2
    assert stored.count() == len(first.evidence) + len(second.evidence)
    assert second.selected_model in ("challenger", "scorecard") and len(second.sweeps) == 4
    assert second.metrics["brier_change"] == pytest.approx(second.metrics["brier_calibrated"] - second.metrics["brier_raw"])
    with pytest.raises(ValueError):
        train_challenger(frame, -1)
    with pytest.raises(ValueError, match="single class"):
        train_challenger(frame.where(f"MODELLING_SPLIT <> 'train' OR {TARGET_12M} = 1"), 0)


def test_stability_index(spark):
    data = [(False, x % 4, 0) for x in range(100)] + [(True, x % 2, None) for x in range(50)] + [(None, 3, 1)] * 9
    frame = spark.createDataFrame(data, "now boolean, v int, w int")
    got = {r.column_name: r for r in stability_index(frame, F.col("now"), {"v": [1.0, 2.0, 3.0], "w": [1.0]}).collect()}
    want = 2 * (0.5 - 0.25) * math.log(2) + 2 * (FLOOR - 0.25) * math.log(FLOOR / 0.25)
    assert got["v"].bands == 4 and got["v"].stability_index == pytest.approx(want)
    assert got["w"].bands == 2 and got["w"].stability_index > 1
    edges = quantile_edges(frame.where("now = false"), ["v"], 4)["v"]
    assert edges == sorted(edges) and set(edges) <= {0.0, 1.0, 2.0, 3.0}


def test_hazard_by_age_is_one_cubic_between_knots(spark):
    """The age part equals the weighted basis, ages outside the range included, and stays a short expression."""
    model = fixed_hazard()
    ages = spark.range(-5, 70)
    both = ages.select(
        model.age_logit(F.col("id")).alias("cubic"),
        model._weighted(0, spline_basis(F.col("id"), *model.age_range)).alias("basis"),
    )
    assert both.agg(F.max(F.abs(F.col("cubic") - F.col("basis")))).first()[0] < 1e-12
    plan = ages.select(model.age_logit(F.col("id")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 1


def test_hazards_of_several_targets_share_their_terms(rows, monkeypatch):
    """The terms are written once for all targets, and first rows to begin with do not move where a fit ends."""
    from vintageline.models import hazard

    written, stored = [], hazard.materialize
    monkeypatch.setattr(hazard, "materialize", lambda frame, name: written.append(name) or stored(frame, name))
    alone = fit_hazard(rows, TARGET_12M)
    written.clear()
    monkeypatch.setattr(hazard, "MANY_ROWS", 1)
    shared = hazard.fit_hazards(rows.withColumn("_again", F.col(TARGET_12M)), (TARGET_12M, "_again"))
    assert written == ["hazard-terms", "hazard-first"]
    for model in shared:
        assert model.coefficients == pytest.approx(alone.coefficients, abs=1e-5)
        assert model.intercept == pytest.approx(alone.intercept, abs=1e-5)


def test_scored_portfolio_stores_what_it_reads(spark, monkeypatch):
    from vintageline.queries import portfolio_queries

    class Stored(Exception):
        pass

    def seen(frame, name):
        raise Stored(frame.columns)

    monkeypatch.setattr(portfolio_queries, "materialize", seen)
    with pytest.raises(Stored) as found:
        portfolio_queries.x17_scored_portfolio(spark, "/root/testdata/sf0.001")
    assert set(FEATURES) < set(found.value.args[0])
    assert not [c for c in found.value.args[0] if "OBSERVATION_DATE" in c or "AVAILABLE_DATE" in c]
