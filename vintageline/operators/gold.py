"""Labelled point-in-time modelling panel and its reconciliation (SRV6, JN5, AGG8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.functions.columns import carry, need_columns, unfold
from vintageline.operators.asof import as_of_dates, join_releases
from vintageline.operators.features import FEATURE_INPUT, indexed_ltv, loan_features
from vintageline.operators.splits import assign_splits
from vintageline.operators.survival import SURVIVAL_INPUT, at_risk_months, loan_facts, survival_panel
from vintageline.settings import HPI_SERIES

GOLD_INPUT = (*SURVIVAL_INPUT, *FEATURE_INPUT, "_source_file")


class ReconciliationError(RuntimeError):
    """Panel rows do not equal the at-risk months of every loan."""


def gold_panel(
    silver: DataFrame, releases: DataFrame, empty: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> DataFrame:
    """Survival rows with features, macro as of the month and as of origination, and splits.

    As-of dates are read from the stored loan-month table, so the panel itself is planned once. Columns that no
    step reads are carried as one value; those named ``empty`` are known to hold NULL only and are not carried. A task's
    rows come ordered by ``sort_by``, sorted while they are narrow.
    """
    absent = {c: silver.schema[c].dataType for c in empty if c not in GOLD_INPUT}
    narrow, rest = carry(silver.drop(*absent), GOLD_INPUT)
    featured = loan_features(survival_panel(narrow))
    days = as_of_dates(silver, "ACT_PERIOD", "ORIG_DATE")
    current = join_releases(featured, releases, dates=days)
    origination = join_releases(current, releases, "ORIG_DATE", (HPI_SERIES,), "ORIG_", dates=days)
    rows = assign_splits(indexed_ltv(origination))
    ordered = rows.sortWithinPartitions(*sort_by) if sort_by else rows
    return unfold(ordered, rest, silver.columns, absent)


def row_count_mismatches(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Loans whose panel rows differ from their at-risk months; a missing side counts as -1 (JN5)."""
    need_columns(gold, ("LOAN_ID", "ACT_PERIOD"), "reconciliation")
    expected = loan_facts(silver).select(
        "LOAN_ID", F.size(at_risk_months()).cast("bigint").alias("EXPECTED_ROWS")
    ).where("EXPECTED_ROWS > 0")
    actual = gold.groupBy("LOAN_ID").agg(F.count(F.lit(1)).alias("ACTUAL_ROWS"))
    return (
        expected.join(actual.hint("merge"), "LOAN_ID", "full")
        .na.fill(-1, ["EXPECTED_ROWS", "ACTUAL_ROWS"])
        .where(F.col("EXPECTED_ROWS") != F.col("ACTUAL_ROWS"))
    )


def reconciliation_counts(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Loans, source rows, panel rows and rows left out, as one row (AGG8)."""
    per_loan = (
        silver.groupBy("LOAN_ID").agg(F.count(F.lit(1)).alias("s")).selectExpr("LOAN_ID", "s", "0L AS g")
    ).unionByName(
        gold.groupBy("LOAN_ID").agg(F.count(F.lit(1)).alias("g")).selectExpr("LOAN_ID", "0L AS s", "g")
    ).groupBy("LOAN_ID").agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
    return per_loan.agg(
        F.count_if(F.col("g") > 0).alias("loan_count"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("silver_rows"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("gold_rows"),
    ).withColumn("excluded_rows", F.col("silver_rows") - F.col("gold_rows"))


def require_reconciled(silver: DataFrame, gold: DataFrame) -> None:
    examples = row_count_mismatches(silver, gold).limit(5).collect()
    if examples:
        raise ReconciliationError(
            "panel rows differ from at-risk months for loans such as "
            + ", ".join(f"{r.LOAN_ID} ({r.ACTUAL_ROWS} for {r.EXPECTED_ROWS})" for r in examples)
        )
