"""Batch scored portfolio and table health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.models.challenger import Calibrated
from vintageline.models.hazard import HazardModel
from vintageline.models.scorecard import Scorecard
from vintageline.portfolio.loss import assign_stage, exposure_at_default, model_term_structure

SCORED_COLUMNS = (
    "LOAN_ID", "ACT_PERIOD", "ACQUISITION_QUARTER", "MODELLING_SPLIT", "SCORE", "PD_12M", "PD_LIFETIME",
    "HAZARD_NEXT_MONTH", "STAGE", "EAD",
)


def remaining_months(rows: DataFrame) -> Column:
    """Reported months to maturity, else original term less loan age, of those columns the rows have."""
    told = [F.col("REM_MONTHS").cast("int")] if "REM_MONTHS" in rows.columns else []
    if {"ORIG_TERM", "LOAN_AGE"} <= set(rows.columns):
        told.append((F.col("ORIG_TERM") - F.col("LOAN_AGE")).cast("int"))
    if not told:
        raise ValueError("lifetime PD needs REM_MONTHS, or ORIG_TERM and LOAN_AGE")
    return F.coalesce(*told)


def scored_portfolio(
    gold: DataFrame,
    card: Scorecard,
    hazard: HazardModel,
    challenger: Calibrated | None = None,
    competing: Sequence[HazardModel] = (),
) -> DataFrame:
    """Points, 12-month and lifetime PD, next-month hazard, stage and exposure per loan-month.

    The 12-month PD is the challenger's where one was selected, else the scorecard's; points are the scorecard's.
    The lifetime PD chains the hazard over the remaining months, beside ``competing`` exits where given. Scoring is
    a map; the stage compares with the loan's first scored month, found in a window of the loan's rows.
    """
    selected = card if challenger is None else challenger
    left = gold.withColumn("_left", remaining_months(gold))
    lifetime = model_term_structure(left, hazard, remaining="_left", competing=competing).drop("PD_12M", "_left")
    scored = hazard.predict(card.points(selected.predict(lifetime, "PD_12M")), "HAZARD_NEXT_MONTH")
    return exposure_at_default(assign_stage(scored, "PD_12M")).select(*SCORED_COLUMNS)


def loan_month_gaps(silver: DataFrame) -> DataFrame:
    """Loans whose months are not consecutive, with how many are missing inside their history."""
    span = (F.months_between(F.max("ACT_PERIOD"), F.min("ACT_PERIOD")) + 1).cast("int")
    months = silver.select("LOAN_ID", "ACT_PERIOD").distinct()
    return (
        months.groupBy("LOAN_ID")
        .agg((span - F.count(F.lit(1))).alias("missing_months"))
        .where("missing_months > 0")
    )


def layer_health(layers: Mapping[str, DataFrame], month: str = "ACT_PERIOD") -> DataFrame:
    """Rows, loans, first and last month of every layer."""
    out = None
    for name, frame in layers.items():
        per_loan = frame.groupBy("LOAN_ID").agg(
            F.count(F.lit(1)).alias("n"), F.min(month).alias("first"), F.max(month).alias("last")
        )
        row = per_loan.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("loans"),
            F.min("first").alias("first_month"),
            F.max("last").alias("last_month"),
        ).select(F.lit(name).alias("layer"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def gate_pass_rate(report: DataFrame) -> DataFrame:
    """Share of expectations of a quality report that passed."""
    passed = F.col("status") == "passed"
    return report.agg(
        F.count(F.lit(1)).alias("expectations"),
        F.count_if(passed).alias("passed"),
        F.avg(passed.cast("double")).alias("pass_rate"),
    )
