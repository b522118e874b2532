"""Survival framing of a loan-month table (SRV1-SRV5, WIN5-WIN7).

Everything a row needs to know about its loan is one map-side-combined aggregate per loan: first
default, first censoring with its code, last month seen, row count and the ordered months. The rows
then meet their loan's facts in one equi-join on the loan, which adaptive execution can split when a
loan is hot. A loan has at most one entry per calendar month, so the month list is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import months_delinquent, need_columns
from vintageline.settings import DELINQUENCY_THRESHOLD, HORIZON_MONTHS

SURVIVAL_INPUT = ("LOAN_ID", "ACT_PERIOD", "DLQ_STATUS", "ZERO_BAL_CODE")

# Zero-balance codes with an exit type of their own.
EXIT_OF_CODE = {"01": "prepaid", "06": "repurchased"}


def _closing_code() -> Column:
    code = F.trim("ZERO_BAL_CODE")
    return F.when(code != "", code)


def loan_facts(silver: DataFrame, threshold: int = DELINQUENCY_THRESHOLD) -> DataFrame:
    """One row per loan: resolved default and censor dates, exit, and the observed months.

    A default in the censoring month counts as default; one after it does not count at all.
    """
    need_columns(silver, SURVIVAL_INPUT, "survival framing")
    month = F.col("ACT_PERIOD")
    defaulted = months_delinquent(F.col("DLQ_STATUS")) >= threshold
    code = _closing_code()
    seen = silver.groupBy("LOAN_ID").agg(
        F.min(F.when(defaulted, month)).alias("raw_default"),
        F.min(F.when(code.isNotNull(), F.struct(month.alias("at"), code.alias("code")))).alias("censor"),
        F.max(month).alias("LAST_OBSERVED_DATE"),
        F.count(F.lit(1)).alias("SOURCE_OBSERVED_MONTHS"),
        F.array_sort(F.collect_set(month)).alias("_months"),
    )
    default_date = F.when(
        F.col("censor").isNull() | (F.col("raw_default") <= F.col("censor.at")), F.col("raw_default")
    )
    kind = F.when(F.col("FIRST_D90_DATE").isNotNull(), "default")
    for value, name in EXIT_OF_CODE.items():
        kind = kind.when(F.col("FIRST_CENSOR_CODE") == value, name)
    kind = kind.when(F.col("FIRST_CENSOR_DATE").isNotNull(), "other_exit").otherwise("right_censored")
    return (
        seen.select(
            "LOAN_ID",
            F.col("censor.at").alias("FIRST_CENSOR_DATE"),
            F.col("censor.code").alias("FIRST_CENSOR_CODE"),
            "LAST_OBSERVED_DATE",
            "SOURCE_OBSERVED_MONTHS",
            default_date.alias("FIRST_D90_DATE"),
            "_months",
        )
        .withColumn("EXIT_DATE", F.least("FIRST_D90_DATE", "FIRST_CENSOR_DATE"))
        .withColumn("EXIT_TYPE", kind)
    )


def at_risk_months() -> Column:
    """Months of the loan's history before its exit; the exit month itself is not at risk."""
    return F.filter(
        "_months", lambda m: F.col("EXIT_DATE").isNull() | (m < F.col("EXIT_DATE"))
    )


def survival_panel(
    silver: DataFrame,
    horizon_months: int = HORIZON_MONTHS,
    threshold: int = DELINQUENCY_THRESHOLD,
) -> DataFrame:
    """At-risk loan-months with next-month and horizon default labels (SRV5)."""
    if horizon_months <= 0 or threshold <= 0:
        raise ValueError("horizon_months and threshold must be positive")
    month, default_date = F.col("ACT_PERIOD"), F.col("FIRST_D90_DATE")
    horizon_end = F.add_months(month, horizon_months)
    next_month = F.add_months(month, 1)
    known_until = F.least("LAST_OBSERVED_DATE", "FIRST_CENSOR_DATE")

    def label(end: Column) -> Column:
        inside = (default_date > month) & (default_date <= end)
        return F.when(inside, 1).when(known_until >= end, 0)

    # Months are numbered where the join has put a loan's rows; the month list of loan_facts is not built here.
    # Unfolded rows are estimated far too low, and a broadcast would bring a whole side to the driver.
    of_loan = Window.partitionBy("LOAN_ID")
    number = F.dense_rank().over(of_loan.orderBy(month))
    facts = loan_facts(silver, threshold).drop("_months")
    kept = [c for c in silver.columns if c not in facts.columns or c == "LOAN_ID"]
    return (
        silver.select(*kept)
        .join(facts.hint("merge"), "LOAN_ID")
        .where(F.col("EXIT_DATE").isNull() | (month < F.col("EXIT_DATE")))
        .select(
            *kept,
            "FIRST_CENSOR_DATE",
            "FIRST_CENSOR_CODE",
            "LAST_OBSERVED_DATE",
            "SOURCE_OBSERVED_MONTHS",
            "FIRST_D90_DATE",
            "EXIT_DATE",
            "EXIT_TYPE",
            horizon_end.alias("HORIZON_END_DATE"),
            label(next_month).alias("DEFAULT_NEXT_MONTH"),
            label(horizon_end).alias("DEFAULT_IN_12M"),
            label(horizon_end).isNotNull().alias("LABEL_OBSERVED_12M"),
            number.alias("AT_RISK_MONTH_NUMBER"),
        )
        .withColumn("AT_RISK_OBSERVED_MONTHS", F.max("AT_RISK_MONTH_NUMBER").over(of_loan).cast("bigint"))
    )
