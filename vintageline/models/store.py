"""Fitted models as rows of a versioned table (MOD11): plain numbers, so scoring needs no refit."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import SparkSession

from vintageline.models.binning import FeatureBins
from vintageline.models.boosting import BoostedModel, Tree
from vintageline.models.challenger import Calibrated, StepModel
from vintageline.models.hazard import HazardModel
from vintageline.models.scorecard import Scorecard
from vintageline.sources.snapshots import publish, read_version

Model = Scorecard | HazardModel | StepModel | BoostedModel | Calibrated
MODEL_TABLE = "name string, kind string, parameters string"


def _tuples(values: Mapping[str, list]) -> dict[str, tuple]:
    return {name: tuple(row) for name, row in values.items()}


def _bins(value: dict) -> FeatureBins:
    return FeatureBins(value["feature"], tuple(value["cuts"]), tuple(value["woe"]), value["missing_woe"])


def _steps(value: dict) -> StepModel:
    return StepModel(_tuples(value["cuts"]), _tuples(value["steps"]), value["missing"], value["intercept"])


def _boosted(value: dict) -> BoostedModel:
    trees = tuple(Tree(**{name: tuple(column) for name, column in tree.items()}) for tree in value["trees"])
    return BoostedModel(tuple(value["features"]), _tuples(value["cuts"]), trees, value["intercept"])


def _hazard(value: dict) -> HazardModel:
    return HazardModel(
        value["medians"],
        tuple(value["age_range"]),
        tuple(value["means"]),
        tuple(value["deviations"]),
        tuple(value["coefficients"]),
        value["intercept"],
    )


READERS = {
    "Scorecard": lambda v: Scorecard({f: _bins(b) for f, b in v["bins"].items()}, v["coefficients"], v["intercept"]),
    "HazardModel": _hazard,
    "StepModel": _steps,
    "BoostedModel": _boosted,
    "Calibrated": lambda v: Calibrated(
        (_boosted if "trees" in v["model"] else _steps)(v["model"]), v["slope"], v["intercept"]
    ),
}


def parameters_of(model: Model) -> str:
    return json.dumps(asdict(model), default=float)


def store_models(
    spark: SparkSession, models: Mapping[str, Model], path: str, sources: Mapping[str, int] | None = None
) -> int:
    """Publish the models under their names as the next version of the table at ``path``."""
    rows = [(name, type(m).__name__, parameters_of(m)) for name, m in models.items()]
    return publish(spark.createDataFrame(rows, MODEL_TABLE).coalesce(1), path, sources)


def load_models(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Model]:
    """The models of one pinned version, or the newest, by name."""
    rows = read_version(spark, path, version).collect()
    return {row["name"]: READERS[row["kind"]](json.loads(row["parameters"])) for row in rows}
