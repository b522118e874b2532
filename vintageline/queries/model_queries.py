"""Model rows, models, metrics, bootstrap and sweeps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vintageline.functions.columns import hex_bucket
from vintageline.models.baseline import fit_marginal_rates
from vintageline.models.binning import FeatureBins, bin_counts, fit_bins, optimal_bins, weight_of, woe_table
from vintageline.models.boosting import best_split, binned_cells, fit_boosted, level_histogram
from vintageline.models.challenger import (
    beats_baseline,
    calibrate,
    fit_steps,
    platt_rows,
    selected_model,
)
from vintageline.models.frame import (
    feature_hash_column,
    hazard_rows,
    labelled_rows,
    loan_sample,
    split_counts,
)
from vintageline.models.hazard import HazardModel, design, fit_hazard, spline_basis
from vintageline.models.scorecard import FACTOR, OFFSET, Scorecard, fit_ridge, fit_scorecard, probability_of
from vintageline.operators.features import loan_features
from vintageline.operators.splits import assign_splits
from vintageline.operators.survival import survival_panel
from vintageline.plans.training import evidence_frame, train_baseline_models, train_challenger
from vintageline.queries.inputs import (
    gold,
    panel,
    query,
    rounded,
    stored_model_frame,
    table,
)
from vintageline.queries.twins import SPLIT, with_gold
from vintageline.sources.snapshots import materialize
from vintageline.settings import BOOTSTRAP_REPLICATES, FEATURES, SEED, TARGET_12M, TARGET_NEXT
from vintageline.validation.bootstrap import PRIME, clustered_gini_interval, gini_differences, poisson_limits
from vintageline.validation.metrics import (
    auc,
    brier,
    brier_change,
    calibration_by_quantile,
    ks_statistic,
    predicted_vs_actual,
)
from vintageline.validation.monotone import sweep_grid, sweep_report
from vintageline.validation.stability import stability_index

# Two fixed scores on the panel, exact in any engine: integers over a constant.
SCORED = (
    SPLIT
    + """,
scored AS (
  SELECT *, CAST(16*(OLTV-55) + 16*(DTI-18) + 3*(810-CSCORE_B) + 1 AS DOUBLE) / 2000 AS pc, CAST(OLTV AS DOUBLE) / 200 AS pb,
    CAST((year(ACT_PERIOD)-year(ORIG_DATE))*12 + month(ACT_PERIOD)-month(ORIG_DATE) AS INT) AS SEASONING_MONTHS,
    least(CSCORE_B, CSCORE_C) AS CLASSIC_FICO
  FROM splitp
),
known AS (SELECT * FROM scored WHERE DEFAULT_IN_12M IS NOT NULL)"""
)


def with_scores(select: str) -> str:
    return f"WITH {SCORED}\n{select}"


def scored_panel(spark, folder):
    rows = loan_features(assign_splits(survival_panel(panel(spark, folder))))
    candidate = (16 * (F.col("OLTV") - 55) + 16 * (F.col("DTI") - 18) + 3 * (810 - F.col("CSCORE_B")) + 1)
    return rows.withColumns(
        {"pc": candidate.cast("double") / 2000, "pb": F.col("OLTV").cast("double") / 200}
    )


def known_rows(spark, folder):
    return scored_panel(spark, folder).where(F.col(TARGET_12M).isNotNull())


def fixed_scorecard() -> Scorecard:
    """A scorecard with given bins and coefficients, to test scaling apart from fitting."""
    return Scorecard(
        {
            "CLASSIC_FICO": FeatureBins("CLASSIC_FICO", (650.0, 700.0, 750.0), (-0.8, -0.2, 0.4, 1.1), 0.1),
            "OLTV": FeatureBins("OLTV", (70.0, 85.0), (0.7, 0.1, -0.6), 0.0),
            "DTI": FeatureBins("DTI", (25.0, 40.0), (0.5, 0.0, -0.4), -0.1),
        },
        {"CLASSIC_FICO": -0.9, "OLTV": -0.7, "DTI": -0.5},
        -2.0,
    )


FIXED_POINTS = f"""
    {OFFSET!r}::DOUBLE - {FACTOR!r}::DOUBLE * (-2.0::DOUBLE
      - 0.9::DOUBLE * CASE WHEN CLASSIC_FICO IS NULL THEN 0.1 WHEN CLASSIC_FICO < 650 THEN -0.8 WHEN CLASSIC_FICO < 700 THEN -0.2
          WHEN CLASSIC_FICO < 750 THEN 0.4 ELSE 1.1 END
      - 0.7::DOUBLE * CASE WHEN OLTV IS NULL THEN 0.0 WHEN OLTV < 70 THEN 0.7 WHEN OLTV < 85 THEN 0.1 ELSE -0.6 END
      - 0.5::DOUBLE * CASE WHEN DTI IS NULL THEN -0.1 WHEN DTI < 25 THEN 0.5 WHEN DTI < 40 THEN 0.0 ELSE -0.4 END)"""


AGE_WEIGHTS = {"default": (-0.9, 0.3, 0.8, 0.5, -0.2, -0.6), "prepaid": (-1.4, -0.5, 0.2, 0.4, 0.3, -0.3)}


def fixed_hazard() -> HazardModel:
    """A hazard with given coefficients: log-odds -5 + 0.02 * (DTI - 30) and a hump over the first 60 months of age."""
    return HazardModel(
        {"SEASONING_MONTHS": 24.0, "DTI": 30.0}, (0.0, 60.0), (0.0,) * 6 + (30.0,), (1.0,) * 7,
        (*AGE_WEIGHTS["default"], 0.02), -5.0,
    )


def fixed_prepayment() -> HazardModel:
    """A hazard of prepayment with given coefficients: log-odds -4 - 0.01 * (DTI - 30) and a part by age."""
    return HazardModel(
        {"SEASONING_MONTHS": 24.0, "DTI": 30.0}, (0.0, 60.0), (0.0,) * 6 + (30.0,), (1.0,) * 7,
        (*AGE_WEIGHTS["prepaid"], -0.01), -4.0,
    )


def age_part_sql(cause: str) -> str:
    """The age part of a given hazard at the whole ages 0 to 60, as a table (a, f)."""
    terms = []
    for i, weight in enumerate(AGE_WEIGHTS[cause]):
        x = f"(a / 15.0::DOUBLE + {3 - i})"
        terms.append(f"{weight}::DOUBLE * {_bump_sql(x)}")
    return f"SELECT a, {' + '.join(terms)} AS f FROM range(61) t(a)"


# Model rows.


@query(
    "prj10_13_model_rows",
    with_gold(
        """SELECT MODELLING_SPLIT, count(*) AS rows, CAST(sum(DEFAULT_IN_12M) AS BIGINT) AS events, count(CURRENT_LTV) AS with_ltv
        FROM gold WHERE DEFAULT_IN_12M IS NOT NULL GROUP BY 1"""
    ),
)
def prj10_13_model_rows(spark, folder):
    from vintageline.models.frame import model_frame

    frame = model_frame(gold(spark, folder))
    return (
        frame.where(F.col("LABEL_OBSERVED_12M") & F.col(TARGET_12M).isNotNull())
        .groupBy("MODELLING_SPLIT")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col(TARGET_12M).cast("bigint")).alias("events"),
            F.count("CURRENT_LTV").alias("with_ltv"),
        )
    )


@query(
    "prj11_loan_sample",
    f"WITH {SPLIT} SELECT LOAN_ID, count(*) AS rows FROM splitp WHERE ('0x' || substr(md5(LOAN_ID), 1, 8))::BIGINT % 10000 < 2500 GROUP BY 1",
)
def prj11_loan_sample(spark, folder):
    rows = loan_sample(assign_splits(survival_panel(panel(spark, folder))), keep=2500, portable=True)
    return rows.groupBy("LOAN_ID").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "prj11_customer_sample",
    """SELECT ('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS bucket, count(*) AS rows,
    count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
)
def prj11_customer_sample(spark, folder):
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    bucket = hex_bucket(F.col("o_custkey").cast("string"), 16).alias("bucket")
    return per_customer.groupBy(bucket).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("customers"))


@query(
    "prj11_loan_sample_fast",
)
def prj11_loan_sample_fast(spark, folder):
    """The default xxhash64 sample; its hash has no SQL twin."""
    rows = loan_sample(panel(spark, folder), keep=2500)
    return rows.groupBy("LOAN_ID").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "prj12_hazard_rows",
    f"""WITH {SPLIT} SELECT MODELLING_SPLIT, count(*) AS rows, CAST(sum(DEFAULT_NEXT_MONTH) AS BIGINT) AS events FROM splitp
    WHERE DEFAULT_NEXT_MONTH IS NOT NULL AND ACT_PERIOD < LAST_OBSERVED_DATE AND MODELLING_SPLIT IN ('train','validation') GROUP BY 1""",
)
def prj12_hazard_rows(spark, folder):
    rows = assign_splits(survival_panel(panel(spark, folder)))
    both = hazard_rows(rows, "train").unionByName(hazard_rows(rows, "validation"))
    return both.groupBy("MODELLING_SPLIT").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(TARGET_NEXT).cast("bigint")).alias("events")
    )


@query(
    "prj15_feature_hash",
    f"""WITH {SPLIT} SELECT MODELLING_SPLIT, sha256('["' || '{'","'.join(FEATURES)}' || '"]') AS feature_hash, count(*) AS rows
    FROM splitp GROUP BY 1""",
)
def prj15_feature_hash(spark, folder):
    """Split counts stamped with the digest of the feature list."""
    counts = split_counts(assign_splits(survival_panel(panel(spark, folder))))
    return counts.select("MODELLING_SPLIT", feature_hash_column().alias("feature_hash"), "rows")


@query("agg9_split_counts", f"WITH {SPLIT} SELECT MODELLING_SPLIT, count(*) AS rows FROM splitp GROUP BY 1")
def agg9_split_counts(spark, folder):
    return split_counts(assign_splits(survival_panel(panel(spark, folder))))


# Models.

_RATES = """rates AS (
  SELECT SEASONING_MONTHS AS age, count(*) AS n, CAST(sum(DEFAULT_IN_12M) AS BIGINT) AS events,
    (sum(DEFAULT_IN_12M) + 20.0::DOUBLE * (SELECT avg(DEFAULT_IN_12M) FROM known WHERE MODELLING_SPLIT='train')) / (count(*) + 20.0::DOUBLE) AS rate
  FROM known WHERE MODELLING_SPLIT='train' GROUP BY 1
)"""


@query(
    "mod1_marginal_rates",
    f"""WITH {SCORED}, {_RATES} SELECT age, n, events, round(rate, 6) AS rate FROM rates
    UNION ALL SELECT NULL, count(*), CAST(sum(DEFAULT_IN_12M) AS BIGINT), round(avg(DEFAULT_IN_12M), 6) FROM known WHERE MODELLING_SPLIT='train'""",
)
def mod1_marginal_rates(spark, folder):
    train = labelled_rows(scored_panel(spark, folder), "train")
    return rounded(fit_marginal_rates(train, TARGET_12M).rates)


@query(
    "mod1_baseline_scores",
    f"""WITH {SCORED}, {_RATES} SELECT LOAN_ID, ACT_PERIOD, round(coalesce(rate,
      (SELECT avg(DEFAULT_IN_12M) FROM known WHERE MODELLING_SPLIT='train')), 6) AS baseline_probability
    FROM known LEFT JOIN rates ON age = SEASONING_MONTHS WHERE MODELLING_SPLIT <> 'train'""",
)
def mod1_baseline_scores(spark, folder):
    known = known_rows(spark, folder)
    rates = fit_marginal_rates(known.where("MODELLING_SPLIT = 'train'"), TARGET_12M)
    return rounded(
        rates.predict(known.where("MODELLING_SPLIT <> 'train'")).select(
            "LOAN_ID", "ACT_PERIOD", "baseline_probability"
        )
    )


_WOE_CUTS = {"CLASSIC_FICO": (650.0, 700.0, 750.0), "OLTV": (65.0, 75.0, 85.0), "DTI": (25.0, 35.0, 45.0)}


def _woe_twin() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN {f} IS NULL THEN -1 "
        + " ".join(f"WHEN {f} < {c} THEN {i}" for i, c in enumerate(cuts))
        + f" ELSE {len(cuts)} END AS bin, DEFAULT_IN_12M AS y FROM known WHERE MODELLING_SPLIT='train'"
        for f, cuts in _WOE_CUTS.items()
    )
    return with_scores(
        f""", c AS (SELECT feature, CAST(bin AS INT) AS bin, count(*) AS rows, CAST(sum(y) AS BIGINT) AS events FROM ({cells}) GROUP BY 1, 2),
        p AS (SELECT *, CASE WHEN events = 0 OR events = rows THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pad,
          sum(events) OVER (PARTITION BY feature) AS e, sum(rows - events) OVER (PARTITION BY feature) AS g FROM c)
        SELECT feature, bin, rows, events, round(CAST(events AS DOUBLE) / rows, 6) AS event_rate,
          round(ln(((rows - events + pad) / g) / ((events + pad) / e)), 6) AS woe,
          round(((rows - events + pad) / g - (events + pad) / e) * ln(((rows - events + pad) / g) / ((events + pad) / e)), 6) AS iv
        FROM p"""
    ).replace("\n,", ",", 1)


@query("mod2_3_woe_table", _woe_twin())
def mod2_3_woe_table(spark, folder):
    train = labelled_rows(scored_panel(spark, folder), "train")
    return rounded(woe_table(bin_counts(train, TARGET_12M, _WOE_CUTS)))


@query("mod2_fitted_bins")
def mod2_fitted_bins(spark, folder):
    """Bins found on the training rows: size floor and direction of the event rate hold."""
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    bins = fit_bins(train, TARGET_12M)
    return rounded(woe_table(bin_counts(train, TARGET_12M, {f: b.cuts for f, b in bins.items()})))


@query(
    "mod4_scorecard_points",
    with_scores(f"SELECT LOAN_ID, ACT_PERIOD, round({FIXED_POINTS}, 6) AS SCORE FROM known"),
)
def mod4_scorecard_points(spark, folder):
    """Points of a scorecard with given bins and coefficients."""
    rows = fixed_scorecard().points(known_rows(spark, folder))
    return rounded(rows.select("LOAN_ID", "ACT_PERIOD", "SCORE"))


@query("mod4_scorecard_fit")
def mod4_scorecard_fit(spark, folder):
    """Bin table of a scorecard fitted on the training rows."""
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    return fit_scorecard(train, TARGET_12M).bin_table(train, TARGET_12M)


def _bump_sql(x: str) -> str:
    """Cubic bump on unit knots."""
    return (
        f"CASE WHEN {x} < 0 OR {x} >= 4 THEN 0.0 WHEN {x} < 1 THEN {x}*{x}*{x}/6 "
        f"WHEN {x} < 2 THEN (-3*{x}*{x}*{x} + 12*{x}*{x} - 12*{x} + 4)/6 "
        f"WHEN {x} < 3 THEN (3*{x}*{x}*{x} - 24*{x}*{x} + 60*{x} - 44)/6 "
        f"ELSE (4-{x})*(4-{x})*(4-{x})/6 END"
    )


def _spline_twin() -> str:
    u = "((least(greatest(CAST(SEASONING_MONTHS AS DOUBLE), 0.0), 48.0) - 0.0) / 12.0 + {shift})"
    terms = []
    for i in range(6):
        x = u.format(shift=3 - i)
        terms.append(f"round({_bump_sql(x)}, 6) AS b{i}")
    return with_scores(f"SELECT SEASONING_MONTHS, count(*) AS rows, {', '.join(terms)} FROM scored GROUP BY SEASONING_MONTHS")


@query("mod5_spline_basis", _spline_twin())
def mod5_spline_basis(spark, folder):
    """Cubic basis of loan age on five knots over 0 to 48 months."""
    rows = scored_panel(spark, folder).groupBy("SEASONING_MONTHS").agg(F.count(F.lit(1)).alias("rows"))
    terms = spline_basis(F.col("SEASONING_MONTHS"), 0.0, 48.0)
    return rounded(rows.select("SEASONING_MONTHS", "rows", *(t.alias(f"b{i}") for i, t in enumerate(terms))))


@query("mod5_hazard_fit")
def mod5_hazard_fit(spark, folder):
    """Mean fitted hazard beside the observed rate per loan age, on the training rows."""
    train = hazard_rows(stored_model_frame(spark, folder), "train")
    model = fit_hazard(train, TARGET_NEXT)
    return predicted_vs_actual(model.predict(train), TARGET_NEXT, "hazard_probability", ["SEASONING_MONTHS"])


@query("mod6_7_challenger_fit")
def mod6_7_challenger_fit(spark, folder):
    """Monotone boosted challenger, calibrated: prediction against outcome per split."""
    frame = stored_model_frame(spark, folder)
    raw = fit_boosted(labelled_rows(frame, "train"), TARGET_12M)
    calibrated = calibrate(raw, labelled_rows(frame, "validation"), TARGET_12M)
    scored = calibrated.predict(raw.predict(frame))
    return predicted_vs_actual(scored, TARGET_12M, "challenger_probability", ["MODELLING_SPLIT"])


@query("mod12_feature_importance")
def mod12_feature_importance(spark, folder):
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    return fit_boosted(train, TARGET_12M).importance(train)


@query(
    "mod7_calibration_rows",
    with_scores(
        """, v AS (SELECT pc AS p, DEFAULT_IN_12M AS y FROM known WHERE MODELLING_SPLIT='validation'),
        t AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(sum(1-y) AS DOUBLE) AS N FROM v),
        c AS (SELECT p, sum(y) AS pos, sum(1-y) AS neg FROM v GROUP BY 1)
        SELECT p, 1.0::DOUBLE AS label, round(pos * (P+1)/(P+2) + neg / (N+2), 6) AS weight FROM c, t
        UNION ALL SELECT p, 0.0::DOUBLE, round(pos + neg - (pos * (P+1)/(P+2) + neg / (N+2)), 6) FROM c, t"""
    ).replace("\n,", ",", 1).replace("t AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(sum(1-y) AS DOUBLE) AS N", "t AS (SELECT CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1-y) AS DOUBLE) AS tn").replace("(P+1)/(P+2)", "(tp+1)/(tp+2)").replace("(N+2)", "(tn+2)"),
)
def mod7_calibration_rows(spark, folder):
    rows = known_rows(spark, folder).where("MODELLING_SPLIT = 'validation'")
    return rounded(platt_rows(rows, TARGET_12M, F.col("pc")))


@query("mod9_11_baseline_evidence")
def mod9_11_baseline_evidence(spark, folder):
    """Evidence rows of the baseline, scorecard and hazard run."""
    run = train_baseline_models(stored_model_frame(spark, folder), 0)
    return evidence_frame(spark, run.evidence)


@query("mod10_11_challenger_evidence")
def mod10_11_challenger_evidence(spark, folder):
    """Evidence rows of the challenger run, sweeps and selection included."""
    run = train_challenger(stored_model_frame(spark, folder), 0)
    return evidence_frame(spark, run.evidence)


# What a fit promises of the rows it was fitted on, without knowing the fit: totals, and the mean prediction.


@query(
    "mod2_bin_totals",
    with_scores(
        "SELECT f.feature, count(*) AS rows, CAST(sum(DEFAULT_IN_12M) AS BIGINT) AS events FROM known, "
        f"(VALUES {', '.join(f"('{f}')" for f in FEATURES)}) f(feature) WHERE MODELLING_SPLIT = 'train' GROUP BY 1"
    ),
)
def mod2_bin_totals(spark, folder):
    """Rows and events over all fitted bins of each feature: no row is lost or counted twice."""
    bins = mod2_fitted_bins(spark, folder)
    return bins.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("events").alias("events"))


def _mean_twin(label: str, split: str, observed: str = "avg({y})") -> str:
    rate = observed.format(y=label)
    return with_scores(
        f"SELECT count(*) AS rows, round({rate}, 3) AS mean_rate FROM scored "
        f"WHERE MODELLING_SPLIT = '{split}' AND {label} IS NOT NULL"
    )


def _mean_of(scored, probability: str):
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(probability), 3).alias("mean_rate"))


@query("mod4_scorecard_mean", _mean_twin("DEFAULT_IN_12M", "train"))
def mod4_scorecard_mean(spark, folder):
    """Mean fitted probability of the training rows; the free intercept makes it the observed rate."""
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    card = fit_scorecard(train, TARGET_12M)
    return _mean_of(card.predict(train), "scorecard_probability")


@query("mod5_hazard_mean", _mean_twin("DEFAULT_NEXT_MONTH", "train"))
def mod5_hazard_mean(spark, folder):
    """Mean fitted hazard of the training rows, which is the observed rate of the next month."""
    train = hazard_rows(stored_model_frame(spark, folder), "train")
    return _mean_of(fit_hazard(train, TARGET_NEXT).predict(train), "hazard_probability")


@query("mod6_challenger_mean", _mean_twin("DEFAULT_IN_12M", "train"))
def mod6_challenger_mean(spark, folder):
    """Mean raw probability of the challenger on its training rows, which is the observed rate."""
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    raw = fit_steps(train, TARGET_12M)
    return _mean_of(raw.predict(train), "challenger_raw")


# Boosted trees: the first level's sums and its best split, with cuts given.

_DIRECTIONS = {"CLASSIC_FICO": -1, "OLTV": 1, "DTI": 1}


def _given_bins(feature: str, cuts, source: str) -> str:
    """Rows (feature, bin, y) of the given cuts; a missing value has bin -1."""
    cases = " ".join(f"WHEN {feature} < {c} THEN {i}" for i, c in enumerate(cuts))
    return (
        f"SELECT '{feature}' AS feature, CAST(CASE WHEN {feature} IS NULL THEN -1 {cases} ELSE {len(cuts)} END AS INT) AS bin, "
        f"DEFAULT_IN_12M AS y FROM {source}"
    )


_FIRST_LEVEL = (
    SCORED
    + f""",
tr AS (SELECT * FROM known WHERE MODELLING_SPLIT = 'train'),
p0 AS (SELECT avg(DEFAULT_IN_12M) AS p FROM tr),
hist AS (SELECT feature, bin, count(*) AS rows, count(*) * p - sum(y) AS gradient, count(*) * p * (1 - p) AS hessian
  FROM ({" UNION ALL ".join(_given_bins(f, c, "tr") for f, c in _WOE_CUTS.items())}), p0 GROUP BY feature, bin, p)"""
)


def _first_level(spark, folder):
    train = labelled_rows(scored_panel(spark, folder), "train")
    features = tuple(_WOE_CUTS)
    cells = materialize(binned_cells(train, TARGET_12M, _WOE_CUTS, features), "boost-cells")
    rows, events = cells.agg(F.sum("rows"), F.sum("events")).first()
    return features, level_histogram(cells, len(features), 4, math.log(events / (rows - events)), [], None)


@query(
    "mod6_first_histogram",
    f"WITH {_FIRST_LEVEL} SELECT feature, bin, rows, round(gradient, 6) AS gradient, round(hessian, 6) AS hessian FROM hist",
)
def mod6_first_histogram(spark, folder):
    """Rows, gradient and hessian per feature and bin before the first tree."""
    features, sums = _first_level(spark, folder)
    names = F.array(*(F.lit(f) for f in features))
    named = sums.select(names[F.col("feature")].alias("feature"), "bin", F.col("rows").cast("bigint").alias("rows"), "gradient", "hessian")
    return rounded(named.withColumn("gradient", F.col("gradient") + 0.0))


@query(
    "mod6_first_split",
    f"""WITH {_FIRST_LEVEL},
    way AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {i}, {d})" for i, (f, d) in enumerate(_DIRECTIONS.items()))}) v(feature, place, direction)),
    cut AS (SELECT feature, place, direction, CAST(c AS INT) AS lim, m AS missing_left FROM way, range(3) r(c), (VALUES (true), (false)) w(m)),
    side AS (SELECT place, feature, direction, lim, missing_left,
        CASE WHEN bin = -1 THEN missing_left ELSE bin <= lim END AS is_left, sum(rows) AS n, sum(gradient) AS g, sum(hessian) AS h
      FROM cut JOIN hist USING (feature) GROUP BY ALL),
    both_sides AS (SELECT l.place, l.feature, l.direction, l.lim, l.missing_left, l.n AS ln, r.n AS rn, l.g AS lg, r.g AS rg, l.h AS lh, r.h AS rh
      FROM side l JOIN side r USING (place, lim, missing_left) WHERE l.is_left AND NOT r.is_left),
    valued AS (SELECT *, -lg / (lh + 1) AS left_value, -rg / (rh + 1) AS right_value,
        (lg * lg / (lh + 1) + rg * rg / (rh + 1) - (lg + rg) * (lg + rg) / (lh + rh + 1)) / 2 AS gain FROM both_sides)
    SELECT feature, lim AS bin, missing_left, round(gain, 6) AS gain, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value
    FROM valued WHERE least(ln, rn) >= 50 AND direction * (right_value - left_value) >= 0
    ORDER BY valued.gain DESC, place, lim, missing_left DESC LIMIT 1""",
)
def mod6_first_split(spark, folder):
    """The split with the most gain that keeps the direction of its feature."""
    features, sums = _first_level(spark, folder)
    tables = np.zeros((3, len(features), 5))
    for r in sums.collect():
        tables[:, r["feature"], r["bin"] + 1] = r["rows"], r["gradient"], r["hessian"]
    gain, feature, at, missing_left, left, right = best_split(
        tables, [_DIRECTIONS[f] for f in features], -math.inf, math.inf
    )
    row = (features[feature], at, missing_left, gain, left, right)
    kind = "feature string, bin int, missing_left boolean, gain double, left_value double, right_value double"
    return rounded(spark.createDataFrame([row], kind))


# Optimal bins: first cuts given, all divisions weighed.

_FIRST_CUTS = {
    "CLASSIC_FICO": (630.0, 660.0, 690.0, 720.0, 750.0, 780.0),
    "OLTV": (60.0, 66.0, 72.0, 78.0, 84.0, 90.0, 96.0),
    "DTI": (20.0, 25.0, 30.0, 35.0, 40.0, 45.0),
}
_SHARE = 0.08


def _optimal_twin() -> str:
    parts = []
    for feature, cuts in _FIRST_CUTS.items():
        m = len(cuts)
        parts.append(
            f"""SELECT '{feature}' AS feature, {_DIRECTIONS[feature]} AS direction, mask, bin,
            CAST(bit_count(mask & ((1 << bin) - 1)) AS INT) AS part, n, e FROM range({1 << m}) k(mask),
            (SELECT bin, count(*) AS n, sum(y) AS e FROM ({_given_bins(feature, cuts, "tr")}) WHERE bin >= 0 GROUP BY bin)"""
        )
    return f"""WITH {SCORED},
    tr AS (SELECT * FROM known WHERE MODELLING_SPLIT = 'train'),
    tot AS (SELECT CAST(sum(DEFAULT_IN_12M) AS DOUBLE) AS te, CAST(sum(1 - DEFAULT_IN_12M) AS DOUBLE) AS tg, count(*) AS tn FROM tr),
    g AS (SELECT feature, direction, mask, part, sum(n) AS n, sum(e) AS e, max(bin) AS last_bin FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL),
    w AS (SELECT *, CASE WHEN e = 0 OR e = n THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pad FROM g),
    v AS (SELECT feature, direction, mask, part, n, e, last_bin, ((n - e + pad) / tg - (e + pad) / te) * ln(((n - e + pad) / tg) / ((e + pad) / te)) AS iv,
        e / n::DOUBLE - lag(e / n::DOUBLE) OVER (PARTITION BY feature, mask ORDER BY part) AS step, tn FROM w, tot),
    d AS (SELECT feature, mask, sum(iv) AS iv FROM v GROUP BY feature, mask
      HAVING min(n) >= {_SHARE} * max(tn) AND coalesce(min(direction * step), 0) >= 0 AND count(*) = bit_count(mask) + 1),
    b AS (SELECT feature, arg_max(mask, iv) AS mask FROM d GROUP BY feature)
    SELECT feature, part AS bin, CAST(last_bin AS INT) AS last_first_bin, CAST(n AS BIGINT) AS rows, CAST(e AS BIGINT) AS events, round(iv, 6) AS iv
    FROM v JOIN b USING (feature, mask)"""


@query("mod2_optimal_bins", _optimal_twin())
def mod2_optimal_bins(spark, folder):
    """The division of given first bins with the most information, beside the weighing of every division."""
    train = labelled_rows(scored_panel(spark, folder), "train")
    counted: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in _FIRST_CUTS}
    for r in bin_counts(train, TARGET_12M, _FIRST_CUTS).collect():
        counted[r.feature][r.bin] = (r.rows, r.events)
    rows = []
    for feature, cuts in _FIRST_CUTS.items():
        total, events = (sum(c[i] for c in counted[feature].values()) for i in (0, 1))
        found = optimal_bins(cuts, counted[feature], _SHARE * total, _DIRECTIONS[feature], total, events)
        last = [cuts.index(b.upper) if b.upper in cuts else max(counted[feature]) for b in found]
        rows += [
            (feature, k, last[k], b.rows, b.events, weight_of(b.rows, b.events, total, events)[1])
            for k, b in enumerate(found)
        ]
    return rounded(spark.createDataFrame(rows, "feature string, bin int, last_first_bin int, rows bigint, events bigint, iv double"))


# Score equations: at a fit, residuals weigh every term as its penalty does.


def _equations_twin(terms, label: str, split: str) -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    return with_scores(
        f"SELECT term, count(*) AS rows, 0.0::DOUBLE AS score FROM scored, (VALUES {listed}) t(term) "
        f"WHERE MODELLING_SPLIT = '{split}' AND {label} IS NOT NULL GROUP BY term"
    )


def _equations(rows, residual, terms: dict, penalties: dict):
    """Per term: rows, and the sum of residual times term less its penalty, to three places."""
    entries = F.array(
        *(
            F.struct(
                F.lit(name).alias("term"), F.count(F.lit(1)).alias("rows"),
                (F.round(F.sum(residual * term) - F.lit(penalties.get(name, 0.0)), 3) + 0.0).alias("score"),
            )
            for name, term in terms.items()
        )
    )
    return rows.agg(entries.alias("e")).select(F.inline("e"))


@query("mod4_score_equations", _equations_twin(("intercept", *FEATURES), "DEFAULT_IN_12M", "train"))
def mod4_score_equations(spark, folder):
    """The fitted scorecard solves its penalised likelihood."""
    train = labelled_rows(stored_model_frame(spark, folder), "train")
    card = fit_scorecard(train, TARGET_12M)
    terms = {"intercept": F.lit(1.0)} | {f: card.bins[f].weight() for f in FEATURES}
    return _equations(train, F.col(TARGET_12M) - probability_of(card.logit()), terms, card.coefficients)


_SPLINE_TERMS = tuple(f"t{i}" for i in range(5 + len(FEATURES)))


@query("mod5_score_equations", _equations_twin(("intercept", *_SPLINE_TERMS), "DEFAULT_NEXT_MONTH", "train"))
def mod5_score_equations(spark, folder):
    """The fitted hazard solves its penalised likelihood over all loan-months."""
    train = hazard_rows(stored_model_frame(spark, folder), "train")
    model = fit_hazard(train, TARGET_NEXT)
    scaled = {
        f"t{i}": (t - F.lit(model.means[i])) / F.lit(model.deviations[i])
        for i, t in enumerate(design(model.medians, model.age_range))
    }
    penalties = {f"t{i}": c for i, c in enumerate(model.coefficients)}
    return _equations(train, F.col(TARGET_NEXT) - probability_of(model.logit()), {"intercept": F.lit(1.0)} | scaled, penalties)


@query(
    "mod7_score_equations",
    with_scores(
        """SELECT term, count(*) AS rows, 0.0::DOUBLE AS score FROM
        (SELECT DISTINCT pc, label FROM known, (VALUES (0), (1)) l(label) WHERE MODELLING_SPLIT = 'validation'),
        (VALUES ('intercept'), ('p')) t(term) GROUP BY term"""
    ),
)
def mod7_score_equations(spark, folder):
    """The sigmoid over a given score solves its likelihood with smoothed targets."""
    rows = known_rows(spark, folder).where("MODELLING_SPLIT = 'validation'")
    cells = materialize(platt_rows(rows, TARGET_12M, F.col("pc")), "platt-rows")
    fit = fit_ridge(cells, [F.col("p")], penalty=0.0)
    residual = F.col("weight") * (F.col("label") - probability_of(F.lit(fit.intercept) + F.lit(fit.coefficients[0]) * F.col("p")))
    return _equations(cells, residual, {"intercept": F.lit(1.0), "p": F.col("p")}, {})


# Metrics.


@query(
    "val1_auc_documents",
    """WITH s AS (SELECT quality AS y, (n_chars % 1000)::BIGINT AS p FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT p, sum(y) AS pos, sum(1-y) AS neg FROM s GROUP BY 1),
    o AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT CAST(sum(pos) AS BIGINT) AS events, CAST(sum(neg) AS BIGINT) AS non_events,
      round(sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc,
      round(2 * sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) - 1, 6) AS gini FROM o""",
)
def val1_auc_documents(spark, folder):
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    scored = labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") % 1000).cast("double").alias("p")
    )
    return rounded(auc(scored, "y", "p"))


def _auc_sql(source: str, by: str, score: str, label: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}CAST(sum(pos) AS BIGINT) AS events, CAST(sum(neg) AS BIGINT) AS non_events,
      sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc
      FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {keys}{score} AS s, sum({label}) AS pos, sum(1-{label}) AS neg FROM {source} GROUP BY {keys}{score}))
      {'GROUP BY ' + by if by else ''}"""


@query(
    "val1_auc_by_split",
    with_scores(
        f"SELECT MODELLING_SPLIT, events, non_events, round(auc, 6) AS auc, round(2*auc-1, 6) AS gini FROM ({_auc_sql('known', 'MODELLING_SPLIT', 'pc', 'DEFAULT_IN_12M')})"
    ),
)
def val1_auc_by_split(spark, folder):
    return rounded(auc(known_rows(spark, folder), TARGET_12M, "pc", ("MODELLING_SPLIT",)))


@query(
    "val2_brier",
    with_scores(
        """SELECT round(avg((pc - DEFAULT_IN_12M) * (pc - DEFAULT_IN_12M)), 6) AS brier_raw,
        round(avg((pb - DEFAULT_IN_12M) * (pb - DEFAULT_IN_12M)), 6) AS brier_calibrated,
        round(avg((pb - DEFAULT_IN_12M) * (pb - DEFAULT_IN_12M)) - avg((pc - DEFAULT_IN_12M) * (pc - DEFAULT_IN_12M)), 6) AS brier_change
        FROM known"""
    ),
)
def val2_brier(spark, folder):
    return rounded(brier_change(known_rows(spark, folder), TARGET_12M, "pc", "pb"))


_BOOT = (
    SCORED
    + f""",
b0 AS (SELECT LOAN_ID, pc, pb, DEFAULT_IN_12M AS y, count(*) AS n FROM known WHERE MODELLING_SPLIT='out_of_time' GROUP BY 1, 2, 3, 4),
hs AS (SELECT LOAN_ID, ('0x' || substr(md5(LOAN_ID), 1, 15))::BIGINT % {PRIME} AS h FROM (SELECT DISTINCT LOAN_ID FROM b0)),
rp AS (SELECT rep, 1 + ('0x' || substr(md5('{SEED}|' || rep || '|a'), 1, 15))::BIGINT % ({PRIME} - 1) AS fa,
    ('0x' || substr(md5('{SEED}|' || rep || '|b'), 1, 15))::BIGINT % {PRIME} AS fb FROM range(1, {BOOTSTRAP_REPLICATES} + 1) r(rep)),
dr AS (SELECT rep, LOAN_ID, len(list_filter({poisson_limits()}, lambda t: t <= (h * fa + fb) % {PRIME})) AS times FROM hs, rp),
rw AS (SELECT 0 AS rep, pc, pb, y, n AS w FROM b0
  UNION ALL SELECT rep, pc, pb, y, n * times FROM b0 JOIN dr USING (LOAN_ID) WHERE times > 0),
ml AS (SELECT rep, 'candidate' AS model, pc AS s, y, w FROM rw UNION ALL SELECT rep, 'baseline', pb, y, w FROM rw),
ms AS (SELECT rep, model, s, sum(w*y) AS pos, sum(w*(1-y)) AS neg FROM ml GROUP BY 1, 2, 3),
mb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep, model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ms),
mg AS (SELECT rep, model, 2 * sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) - 1 AS gini
  FROM mb GROUP BY 1, 2),
df AS (SELECT rep, max(gini) FILTER (model='candidate') - max(gini) FILTER (model='baseline') AS d FROM mg GROUP BY 1),
iv AS (SELECT max(d) FILTER (rep = 0) AS estimate, quantile_cont(d, 0.025) FILTER (rep > 0) AS lower,
    quantile_cont(d, 0.975) FILTER (rep > 0) AS upper, count(d) FILTER (rep > 0) AS successful_replicates FROM df)"""
)


@query("val3_bootstrap_replicates", f"WITH {_BOOT} SELECT CAST(rep AS INT) AS rep, round(d, 6) AS difference FROM df")
def val3_bootstrap_replicates(spark, folder):
    rows = known_rows(spark, folder).where("MODELLING_SPLIT = 'out_of_time'")
    return rounded(
        gini_differences(rows, TARGET_12M, "pc", "pb", portable=True)
    )


@query(
    "val3_bootstrap_interval",
    f"""WITH {_BOOT} SELECT round(estimate, 6) AS estimate, round(lower, 6) AS lower, round(upper, 6) AS upper,
    successful_replicates, successful_replicates >= {BOOTSTRAP_REPLICATES // 2} AS usable FROM iv""",
)
def val3_bootstrap_interval(spark, folder):
    rows = known_rows(spark, folder).where("MODELLING_SPLIT = 'out_of_time'")
    return rounded(
        clustered_gini_interval(rows, TARGET_12M, "pc", "pb", portable=True)
    )


@query(
    "mod8_model_selection",
    f"""WITH {_BOOT} SELECT CASE WHEN lower > 0 THEN 'challenger' ELSE 'scorecard' END AS selected_model,
    lower > 0 AS beats_baseline FROM iv""",
)
def mod8_model_selection(spark, folder):
    row = val3_bootstrap_interval(spark, folder)
    return row.select(
        selected_model(F.col("lower")).alias("selected_model"),
        beats_baseline(F.col("lower")).alias("beats_baseline"),
    )


@query("val4_challenger_sweeps")
def val4_challenger_sweeps(spark, folder):
    """Sweeps of a challenger fitted on the training rows; the worst reversal is zero."""
    from vintageline.models.hazard import feature_medians

    frame = stored_model_frame(spark, folder)
    train = labelled_rows(frame, "train")
    calibrated = calibrate(fit_boosted(train, TARGET_12M), labelled_rows(frame, "validation"), TARGET_12M)
    return sweep_report(sweep_grid(spark, feature_medians(train)), calibrated.probability())


@query(
    "val4_score_reversals",
    with_scores(
        """, a AS (SELECT OLTV AS step, avg(pc) AS p FROM known GROUP BY 1),
        l AS (SELECT *, lag(p) OVER (ORDER BY step) - p AS r FROM a)
        SELECT 'OLTV' AS feature, 1 AS direction, round(min(p), 6) AS minimum_probability, round(max(p), 6) AS maximum_probability,
        round(greatest(max(r), 0.0::DOUBLE), 6) AS worst_violation FROM l"""
    ).replace("\n,", ",", 1),
)
def val4_score_reversals(spark, folder):
    """Worst reversal of the mean score along OLTV, with the sweep report."""
    steps = known_rows(spark, folder).groupBy("OLTV").agg(F.avg("pc").alias("p"))
    grid = steps.select(F.lit("OLTV").alias("swept"), F.lit(1.0).alias("direction"), F.col("OLTV").alias("step"), "p")
    return rounded(sweep_report(grid, F.col("p")))


@query(
    "x1_ks_by_split",
    with_scores(
        """, g AS (SELECT MODELLING_SPLIT, pc, sum(DEFAULT_IN_12M) AS e, sum(1-DEFAULT_IN_12M) AS o FROM known GROUP BY 1, 2)
        SELECT MODELLING_SPLIT, round(max(abs(ce / te - co / tot)), 6) AS ks FROM (
          SELECT MODELLING_SPLIT, CAST(sum(e) OVER (PARTITION BY MODELLING_SPLIT ORDER BY pc) AS DOUBLE) AS ce,
            CAST(sum(o) OVER (PARTITION BY MODELLING_SPLIT ORDER BY pc) AS DOUBLE) AS co,
            sum(e) OVER (PARTITION BY MODELLING_SPLIT) AS te, sum(o) OVER (PARTITION BY MODELLING_SPLIT) AS tot FROM g) GROUP BY 1"""
    ).replace("\n,", ",", 1),
)
def x1_ks_by_split(spark, folder):
    return rounded(ks_statistic(known_rows(spark, folder), TARGET_12M, "pc", ("MODELLING_SPLIT",)))


@query(
    "x2_calibration_deciles",
    with_scores(
        """, r AS (SELECT pc, DEFAULT_IN_12M AS y, rank() OVER (ORDER BY pc) - 1 AS below, count(*) OVER () AS n FROM known)
        SELECT CAST(below * 10 // n + 1 AS INT) AS bin, count(*) AS rows, round(avg(pc), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate
        FROM r GROUP BY 1"""
    ).replace("\n,", ",", 1),
)
def x2_calibration_deciles(spark, folder):
    return rounded(calibration_by_quantile(known_rows(spark, folder), TARGET_12M, "pc"))


@query(
    "x2_calibration_by_vintage",
    with_scores(
        """SELECT ACQUISITION_QUARTER, count(*) AS rows, round(avg(pc), 6) AS mean_predicted, round(avg(DEFAULT_IN_12M), 6) AS observed_rate,
        round(avg(DEFAULT_IN_12M) / avg(pc), 6) AS actual_to_predicted FROM known GROUP BY 1"""
    ),
)
def x2_calibration_by_vintage(spark, folder):
    return rounded(predicted_vs_actual(known_rows(spark, folder), TARGET_12M, "pc", ["ACQUISITION_QUARTER"]))


@query(
    "x3_brier_skill",
    with_scores(
        """SELECT MODELLING_SPLIT, count(*) AS rows, round(avg((pc-DEFAULT_IN_12M)*(pc-DEFAULT_IN_12M)), 6) AS brier,
        round(avg(DEFAULT_IN_12M), 6) AS base_rate,
        round(1 - avg((pc-DEFAULT_IN_12M)*(pc-DEFAULT_IN_12M)) / (avg(DEFAULT_IN_12M) * (1 - avg(DEFAULT_IN_12M))), 6) AS brier_skill
        FROM known GROUP BY 1"""
    ),
)
def x3_brier_skill(spark, folder):
    return rounded(brier(known_rows(spark, folder), TARGET_12M, "pc", ("MODELLING_SPLIT",)))


def _stability_twin(reference: str, current: str, edges: dict) -> str:
    def cells(source):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CASE WHEN {c} IS NULL THEN -1 ELSE "
            + " + ".join(f"CAST({c} >= {e} AS INT)" for e in es)
            + f" END AS band FROM {source}"
            for c, es in edges.items()
        )

    return f"""r AS (SELECT column_name, band, count(*) AS n FROM ({cells(reference)}) GROUP BY 1, 2),
    c AS (SELECT column_name, band, count(*) AS n FROM ({cells(current)}) GROUP BY 1, 2),
    w AS (SELECT column_name, band, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn FROM r FULL JOIN c USING (column_name, band)),
    s AS (SELECT column_name, greatest(rn / CAST(sum(rn) OVER (PARTITION BY column_name) AS DOUBLE), 0.0001::DOUBLE) AS e,
      greatest(cn / CAST(sum(cn) OVER (PARTITION BY column_name) AS DOUBLE), 0.0001::DOUBLE) AS a FROM w)
    SELECT column_name, count(*) AS bands, round(sum((a - e) * ln(a / e)), 6) AS stability_index FROM s GROUP BY 1"""


_SCORE_EDGES = {"pc": [k / 10 for k in range(1, 10)]}
_FEATURE_EDGES = {
    "CLASSIC_FICO": [640.0, 680.0, 720.0, 760.0],
    "OLTV": [65.0, 75.0, 85.0, 95.0],
    "DTI": [25.0, 35.0, 45.0],
    "SEASONING_MONTHS": [6.0, 12.0, 24.0, 36.0],
}
_SIDES = """, tr AS (SELECT * FROM scored WHERE MODELLING_SPLIT='train'), ov AS (SELECT * FROM scored WHERE MODELLING_SPLIT='out_of_vintage'), """


def _held_out_against_train():
    split = F.col("MODELLING_SPLIT")
    return F.when(split == "out_of_vintage", True).when(split == "train", False)


@query("x4_score_psi", f"WITH {SCORED}{_SIDES}{_stability_twin('tr', 'ov', _SCORE_EDGES)}")
def x4_score_psi(spark, folder):
    return rounded(stability_index(scored_panel(spark, folder), _held_out_against_train(), _SCORE_EDGES))


@query("x5_feature_csi", f"WITH {SCORED}{_SIDES}{_stability_twin('tr', 'ov', _FEATURE_EDGES)}")
def x5_feature_csi(spark, folder):
    return rounded(stability_index(scored_panel(spark, folder), _held_out_against_train(), _FEATURE_EDGES))


@query(
    "x6_predicted_vs_actual",
    with_scores(
        """SELECT MODELLING_SPLIT, STATE, PURPOSE, count(*) AS rows, round(avg(pc), 6) AS mean_predicted, round(avg(DEFAULT_IN_12M), 6) AS observed_rate,
        round(avg(DEFAULT_IN_12M) / avg(pc), 6) AS actual_to_predicted FROM known GROUP BY 1, 2, 3"""
    ),
)
def x6_predicted_vs_actual(spark, folder):
    return rounded(
        predicted_vs_actual(known_rows(spark, folder), TARGET_12M, "pc", ["MODELLING_SPLIT", "STATE", "PURPOSE"])
    )
