"""Temporal and vintage splits (PRJ8, PRJ9, JN6, VAL5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.functions.columns import need_columns, source_quarter
from vintageline.settings import HELD_OUT_QUARTERS, TRAIN_END, VALIDATION_END


class SplitError(ValueError):
    """A source file has no quarter, or a loan sits on both sides of a split."""


def assign_splits(panel: DataFrame) -> DataFrame:
    """Add quarter, temporal split, held-out flag and the modelling split, where held out wins.

    A file name without a quarter gives a NULL quarter; ``require_quarters`` turns that into an error.
    """
    need_columns(panel, ("LOAN_ID", "ACT_PERIOD", "_source_file"), "split assignment")
    month = F.col("ACT_PERIOD")
    temporal = (
        F.when(month <= F.lit(TRAIN_END), "train")
        .when(month <= F.lit(VALIDATION_END), "validation")
        .otherwise("out_of_time")
    )
    return (
        panel.withColumn("ACQUISITION_QUARTER", source_quarter(F.col("_source_file")))
        .withColumn("TEMPORAL_SPLIT", temporal)
        .withColumn("IS_OUT_OF_VINTAGE", F.col("ACQUISITION_QUARTER").isin(*HELD_OUT_QUARTERS))
        .withColumn(
            "MODELLING_SPLIT",
            F.when(F.col("IS_OUT_OF_VINTAGE"), "out_of_vintage").otherwise(F.col("TEMPORAL_SPLIT")),
        )
    )


def unparsed_sources(frame: DataFrame) -> DataFrame:
    """Distinct source files, NULL included, from which no quarter can be read."""
    return (
        frame.where(source_quarter(F.col("_source_file")).isNull()).select("_source_file").distinct()
    )


def require_quarters(frame: DataFrame) -> None:
    bad = [row[0] for row in unparsed_sources(frame).limit(5).collect()]
    if bad:
        raise SplitError(f"no acquisition quarter in source files such as {bad}")


def straddling_loans(panel: DataFrame) -> DataFrame:
    """Loans with rows in both the training and the held-out-vintage split."""
    need_columns(panel, ("LOAN_ID", "MODELLING_SPLIT"), "split integrity")
    split = F.col("MODELLING_SPLIT")
    return (
        panel.where(split.isin("train", "out_of_vintage"))
        .groupBy("LOAN_ID")
        .agg(
            F.max((split == "train").cast("int")).alias("t"),
            F.max((split == "out_of_vintage").cast("int")).alias("v"),
        )
        .where((F.col("t") == 1) & (F.col("v") == 1))
        .select("LOAN_ID")
    )


def require_split_integrity(panel: DataFrame) -> None:
    if not straddling_loans(panel).isEmpty():
        raise SplitError("a loan appears in both train and out_of_vintage")
