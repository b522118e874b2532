"""Model rows: column contract, loan sample, labelled and hazard rows (PRJ10-PRJ15, MOD13, AGG9)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.functions.columns import hex_bucket, need_columns
from vintageline.settings import (
    FEATURES,
    OUTCOME_COLUMNS,
    SAMPLE_BUCKETS,
    SAMPLE_KEEP,
    TARGET_12M,
    TARGET_NEXT,
)

MODEL_COLUMNS = (
    "LOAN_ID", "ACT_PERIOD", "LAST_OBSERVED_DATE", "MODELLING_SPLIT", "LABEL_OBSERVED_12M",
    *FEATURES, TARGET_12M, TARGET_NEXT,
)


def require_no_outcomes(features: Sequence[str]) -> None:
    leaking = sorted(set(features) & set(OUTCOME_COLUMNS))
    if leaking:
        raise ValueError(f"features include outcome columns: {leaking}")


def loan_sample(
    gold: DataFrame,
    buckets: int = SAMPLE_BUCKETS,
    keep: int = SAMPLE_KEEP,
    portable: bool = False,
) -> DataFrame:
    """Whole-loan hash sample (PRJ11): every month of a loan is in or out together.

    ``portable`` takes the bucket from md5, which any SQL engine reproduces.
    """
    if not 1 <= keep <= buckets:
        raise ValueError("keep must lie between 1 and buckets")
    loan = F.col("LOAN_ID")
    bucket = hex_bucket(loan, buckets) if portable else F.pmod(F.xxhash64(loan), F.lit(buckets))
    return gold.where(bucket < keep)


def model_frame(gold: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The positive column list of the models; nothing else of the panel is carried along."""
    require_no_outcomes(features)
    need_columns(gold, MODEL_COLUMNS, "model frame")
    return gold.select(*MODEL_COLUMNS)


def labelled_rows(frame: DataFrame, split: str, target: str = TARGET_12M) -> DataFrame:
    """Rows of a split whose twelve-month label is known (PRJ13)."""
    return frame.where(
        (F.col("MODELLING_SPLIT") == split) & F.col("LABEL_OBSERVED_12M") & F.col(target).isNotNull()
    )


def hazard_rows(frame: DataFrame, split: str) -> DataFrame:
    """Rows of a split with a known next month, before the loan's last month seen (PRJ12)."""
    return frame.where(
        (F.col("MODELLING_SPLIT") == split)
        & F.col(TARGET_NEXT).isNotNull()
        & (F.col("ACT_PERIOD") < F.col("LAST_OBSERVED_DATE"))
    )


def require_both_classes(rows: DataFrame, target: str, what: str) -> None:
    counts = rows.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    if not all(counts):
        raise ValueError(f"{what} rows hold a single class of {target}: {counts[0]} / {counts[1]}")


def split_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("MODELLING_SPLIT").agg(F.count(F.lit(1)).alias("rows"))


def feature_list_hash(features: Sequence[str] = FEATURES) -> str:
    """Digest of the ordered feature list, as compact JSON (PRJ15)."""
    return hashlib.sha256(json.dumps(list(features), separators=(",", ":")).encode()).hexdigest()


def feature_hash_column(features: Sequence[str] = FEATURES) -> Column:
    """The same digest computed by Spark."""
    return F.sha2(F.to_json(F.array(*(F.lit(f) for f in features))), 256)
