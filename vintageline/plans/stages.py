"""The publication stages by name: macro, bronze, silver, gold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from vintageline.plans.publication import publish_gold_from, publish_silver
from vintageline.sources.contract import DEFAULT_WIDTH
from vintageline.sources.rawfiles import ingest
from vintageline.sources.releases import publish_releases


@dataclass(frozen=True)
class Places:
    """Where a run reads and keeps its tables, below one root."""

    root: str
    raw_paths: Sequence[str] = ()
    release_folder: str = ""
    width: int = DEFAULT_WIDTH

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


STAGES: dict[str, Callable[[SparkSession, Places], object]] = {
    "macro": lambda spark, at: publish_releases(spark, at.release_folder, at.table("macro")),
    "bronze": lambda spark, at: ingest(spark, at.raw_paths, at.table("bronze"), at.width),
    "silver": lambda spark, at: publish_silver(
        spark, at.table("bronze"), at.table("silver"), at.table("servicer"), at.table("quarantine")
    ),
    "gold": lambda spark, at: publish_gold_from(spark, at.table("silver"), at.table("macro"), at.table("gold")),
}


def run_stage(spark: SparkSession, stage: str, places: Places) -> object:
    """Run one stage and return what it reports; an unknown name is refused."""
    if stage not in STAGES:
        raise ValueError(f"stage {stage!r} is not one of {', '.join(STAGES)}")
    return STAGES[stage](spark, places)
