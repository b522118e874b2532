"""Row-local model features (PRJ4-PRJ7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.functions.columns import lowest_score, need_columns
from vintageline.settings import HPI_SERIES

FEATURE_INPUT = ("ACT_PERIOD", "ORIG_DATE", "CURRENT_UPB", "ORIG_UPB", "OLTV", "CSCORE_B", "CSCORE_C")


def loan_features(panel: DataFrame) -> DataFrame:
    """Age in whole months, lower credit score, property value at origination, unindexed LTV."""
    need_columns(panel, FEATURE_INPUT, "loan features")
    oltv = F.col("OLTV").cast("double")
    value = F.col("ORIGINAL_PROPERTY_VALUE")
    return (
        panel.withColumn(
            "SEASONING_MONTHS", F.floor(F.months_between("ACT_PERIOD", "ORIG_DATE")).cast("int")
        )
        .withColumn("CLASSIC_FICO", lowest_score("CSCORE_B", "CSCORE_C"))
        .withColumn(
            "ORIGINAL_PROPERTY_VALUE",
            F.when(oltv > 0, F.col("ORIG_UPB").cast("double") / (oltv / 100.0)),
        )
        .withColumn(
            "CURRENT_LTV_UNINDEXED",
            F.when(value > 0, F.col("CURRENT_UPB").cast("double") / value * 100.0),
        )
    )


def indexed_ltv(panel: DataFrame) -> DataFrame:
    """Property value moved by the price index since origination, and LTV against it."""
    now, then = HPI_SERIES, f"ORIG_{HPI_SERIES}"
    need_columns(panel, ("CURRENT_UPB", "ORIGINAL_PROPERTY_VALUE", now, then), "indexed LTV")
    estimate = F.try_divide(
        F.col("ORIGINAL_PROPERTY_VALUE") * F.col(now).cast("double"), F.col(then).cast("double")
    )
    value = F.col("ESTIMATED_CURRENT_PROPERTY_VALUE")
    return panel.withColumn("ESTIMATED_CURRENT_PROPERTY_VALUE", estimate).withColumn(
        "CURRENT_LTV", F.when(value > 0, F.col("CURRENT_UPB").cast("double") / value * 100.0)
    )
