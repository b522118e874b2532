"""Training flows and their evidence (MOD9, MOD10, MOD11)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vintageline.models.baseline import MarginalRates, fit_marginal_rates, require_usable
from vintageline.models.boosting import BoostedModel, fit_boosted
from vintageline.models.challenger import Calibrated, StepModel, calibrate
from vintageline.models.directions import directions_of
from vintageline.models.frame import (
    feature_list_hash,
    hazard_rows,
    labelled_rows,
    loan_sample,
    model_frame,
    require_both_classes,
    split_counts,
)
from vintageline.models.hazard import HazardModel, feature_medians, fit_hazard
from vintageline.models.scorecard import Scorecard, fit_scorecard
from vintageline.models.store import parameters_of
from vintageline.settings import (
    BOOTSTRAP_REPLICATES,
    FEATURES,
    RISK_DIRECTION,
    SAMPLE_BUCKETS,
    SEED,
    TARGET_12M,
    TARGET_NEXT,
    TRAIN_END,
    VALIDATION_END,
)
from vintageline.sources.snapshots import read_version
from vintageline.validation.bootstrap import require_interval
from vintageline.validation.metrics import auc, brier_change
from vintageline.validation.monotone import require_monotone, sweep_grid, sweep_report

EVIDENCE_SCHEMA = "run_id string, kind string, key string, value string"


@dataclass(frozen=True)
class BaselineRun:
    run_id: str
    gold_version: int
    baseline: MarginalRates
    scorecard: Scorecard
    hazard: HazardModel
    metrics: dict[str, float]
    evidence: list[tuple[str, str, str, str]]

    @property
    def scorecard_beats_baseline(self) -> bool:
        return self.metrics["gini_improvement_lower"] > 0


@dataclass(frozen=True)
class ChallengerRun:
    run_id: str
    gold_version: int
    scorecard: Scorecard
    raw: BoostedModel | StepModel
    calibrated: Calibrated
    metrics: dict[str, float]
    sweeps: list[Row]
    evidence: list[tuple[str, str, str, str]]

    @property
    def selected_model(self) -> str:
        return "challenger" if self.metrics["gini_improvement_lower"] > 0 else "scorecard"


def load_model_frame(
    spark: SparkSession,
    gold_path: str,
    version: int,
    buckets: int = SAMPLE_BUCKETS,
    keep: int | None = None,
) -> DataFrame:
    """Model columns of one pinned panel version; with ``keep``, only that many of the loan buckets."""
    gold = read_version(spark, gold_path, version)
    return model_frame(gold if keep is None else loan_sample(gold, buckets, keep))


def _auc(rows: DataFrame, target: str, score: str) -> float:
    return auc(rows, target, score).first().auc


def _aucs(rows: DataFrame, target: str, scores: Mapping[str, str]) -> dict[str, float]:
    """AUC of several scores of the same rows, ranked in one job."""
    models = F.array(
        *(F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("score")) for name, c in scores.items())
    )
    ranked = auc(rows.select(target, F.inline(models)), target, "score", ("model",))
    return {r["model"]: r["auc"] for r in ranked.collect()}


def _run_id(kind: str, gold_version: int, replicates: int, portable: bool) -> str:
    """The same inputs and settings make the same run."""
    parts = (kind, gold_version, feature_list_hash(), SEED, replicates, portable)
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:32]


def _interval_metrics(row: Row) -> dict[str, float]:
    return {
        "gini_improvement": row.estimate,
        "gini_improvement_lower": row.lower,
        "gini_improvement_upper": row.upper,
        "bootstrap_successful_replicates": float(row.successful_replicates),
    }


def _evidence(run_id: str, sections: dict[str, dict]) -> list[tuple[str, str, str, str]]:
    return [
        (run_id, kind, key, value if isinstance(value, str) else json.dumps(value))
        for kind, entries in sections.items()
        for key, value in entries.items()
    ]


def evidence_frame(spark: SparkSession, evidence: list) -> DataFrame:
    """Run evidence as (run_id, kind, key, value) rows (MOD11)."""
    return spark.createDataFrame(evidence, EVIDENCE_SCHEMA)


def record_evidence(spark: SparkSession, evidence: list, path: str) -> None:
    """Append a run's evidence to the evidence table."""
    evidence_frame(spark, evidence).coalesce(1).write.mode("append").parquet(path)


def _common_contract(frame: DataFrame, gold_version: int) -> dict[str, dict]:
    return {
        "source": {"gold_version": gold_version},
        "features": {"list": list(FEATURES), "hash": feature_list_hash()},
        "splits": {
            "train_end": TRAIN_END.isoformat(),
            "validation_end": VALIDATION_END.isoformat(),
            "precedence": "held-out vintages before temporal splits",
            **{f"rows_{r.MODELLING_SPLIT}": r.rows for r in split_counts(frame).collect()},
        },
    }


def train_baseline_models(
    frame: DataFrame, gold_version: int, replicates: int = BOOTSTRAP_REPLICATES, portable: bool = False
) -> BaselineRun:
    """Fit baseline, scorecard and hazard on train; compare on validation (MOD9)."""
    if gold_version < 0:
        raise ValueError("the panel version must not be negative")
    train, valid = labelled_rows(frame, "train"), labelled_rows(frame, "validation")
    hazard_train, hazard_valid = hazard_rows(frame, "train"), hazard_rows(frame, "validation")
    for rows, target, what in (
        (train, TARGET_12M, "training"),
        (valid, TARGET_12M, "validation"),
        (hazard_train, TARGET_NEXT, "hazard training"),
        (hazard_valid, TARGET_NEXT, "hazard validation"),
    ):
        require_both_classes(rows, target, what)
    require_usable(train, TARGET_12M)
    baseline = fit_marginal_rates(train, TARGET_12M)
    scorecard = fit_scorecard(train, TARGET_12M)
    hazard = fit_hazard(hazard_train, TARGET_NEXT)
    scored = scorecard.predict(baseline.predict(valid))
    gain = require_interval(
        scored, TARGET_12M, "scorecard_probability", "baseline_probability",
        replicates=replicates, portable=portable,
    )
    aucs = _aucs(
        scored, TARGET_12M, {"baseline": "baseline_probability", "scorecard": "scorecard_probability"}
    )
    baseline_auc, scorecard_auc = aucs["baseline"], aucs["scorecard"]
    metrics = {
        "baseline_auc": baseline_auc,
        "baseline_gini": 2 * baseline_auc - 1,
        "scorecard_auc": scorecard_auc,
        "scorecard_gini": 2 * scorecard_auc - 1,
        "hazard_auc": _auc(hazard.predict(hazard_valid), TARGET_NEXT, "hazard_probability"),
        **_interval_metrics(gain),
    }
    run_id = _run_id("baseline", gold_version, replicates, portable)
    sections = _common_contract(frame, gold_version)
    sections["targets"] = {"scorecard": TARGET_12M, "hazard": TARGET_NEXT}
    sections["metric"] = metrics
    sections["scorecard"] = {
        f: {"cuts": b.cuts, "woe": b.woe, "missing_woe": b.missing_woe, "coefficient": scorecard.coefficients[f]}
        for f, b in scorecard.bins.items()
    } | {"intercept": scorecard.intercept}
    sections["model"] = {"scorecard": parameters_of(scorecard), "hazard": parameters_of(hazard)}
    return BaselineRun(
        run_id, gold_version, baseline, scorecard, hazard, metrics, _evidence(run_id, sections)
    )


def train_challenger(
    frame: DataFrame,
    gold_version: int,
    replicates: int = BOOTSTRAP_REPLICATES,
    portable: bool = False,
    fit: Callable[[DataFrame, str], BoostedModel | StepModel] = fit_boosted,
) -> ChallengerRun:
    """Fit on train, calibrate on validation, select on out-of-time rows (MOD10).

    ``fit`` makes the challenger from rows and target; ``fit_steps`` gives the additive one.
    """
    if gold_version < 0:
        raise ValueError("the panel version must not be negative")
    train, valid, later = (
        labelled_rows(frame, split) for split in ("train", "validation", "out_of_time")
    )
    for rows, what in ((train, "train"), (valid, "validation"), (later, "out_of_time")):
        require_both_classes(rows, TARGET_12M, what)
    scorecard = fit_scorecard(train, TARGET_12M)
    raw = fit(train, TARGET_12M)
    calibrated = calibrate(raw, valid, TARGET_12M)
    grid = sweep_grid(frame.sparkSession, feature_medians(train))
    sweeps = require_monotone(sweep_report(grid, calibrated.probability()))
    scored = calibrated.predict(raw.predict(scorecard.predict(later)))
    gain = require_interval(
        scored, TARGET_12M, "challenger_probability", "scorecard_probability",
        replicates=replicates, portable=portable,
    )
    aucs = _aucs(
        scored,
        TARGET_12M,
        {
            "scorecard": "scorecard_probability",
            "challenger_raw": "challenger_raw",
            "challenger_calibrated": "challenger_probability",
        },
    )
    errors = brier_change(scored, TARGET_12M, "challenger_raw", "challenger_probability").first()
    metrics = {f"{name}_auc": value for name, value in aucs.items()}
    metrics |= {f"{name}_gini": 2 * value - 1 for name, value in aucs.items()}
    metrics |= errors.asDict() | _interval_metrics(gain)
    run_id = _run_id("challenger", gold_version, replicates, portable)
    sections = _common_contract(frame, gold_version)
    sections["calibration"] = {
        "method": "sigmoid", "fitted_on": "validation", "evaluated_on": "out_of_time",
        "slope": calibrated.slope, "intercept": calibrated.intercept,
    }
    sections["directions"] = dict(zip(FEATURES, directions_of())) | {"constrained": list(RISK_DIRECTION)}
    sections["metric"] = metrics
    sections["sweep"] = {r.feature: r.asDict() for r in sweeps}
    sections["importance"] = {r.feature: r.importance for r in raw.importance(train).collect()}
    sections["selection"] = {
        "selected_model": "challenger" if gain.lower > 0 else "scorecard",
        "rule": "challenger when the lower bound of its Gini gain is above zero",
    }
    sections["model"] = {"scorecard": parameters_of(scorecard), "challenger": parameters_of(calibrated)}
    return ChallengerRun(
        run_id, gold_version, scorecard, raw, calibrated, metrics, sweeps, _evidence(run_id, sections)
    )
