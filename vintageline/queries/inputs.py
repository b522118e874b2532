"""Inputs of the registered queries: the given tables and the fixtures derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintageline.models.frame import model_frame
from vintageline.operators.gold import gold_panel
from vintageline.sources.snapshots import materialize, shared_folder
from vintageline.sources.synthetic import synthetic_panel, synthetic_releases

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}

RELEASE_MONTHS = 204


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name, with its SQL twin where one exists."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if twin is not None:
            TWINS[name] = twin
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return synthetic_panel(table(spark, folder, "customer"))


def releases(spark: SparkSession) -> DataFrame:
    return synthetic_releases(spark.range(RELEASE_MONTHS).withColumnRenamed("id", "i"))


def gold(spark: SparkSession, folder: str) -> DataFrame:
    return gold_panel(panel(spark, folder), releases(spark))


def use_scratch(spark: SparkSession) -> str:
    """A new folder under the session's shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored_model_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Model columns of the panel, written once so that a fit does not rebuild the panel per pass."""
    return materialize(model_frame(gold(spark, folder)), "model-frame")


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return frame.select(
        *(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes)
    )
