"""Competing exits: incidence of default beside prepayment and other exits (X9, SRV1).

A loan that prepays can no longer default. Chaining default hazards alone gives the PD of a portfolio nobody ever
leaves; here the months of all causes are chained together, so that the incidences of the causes and the share still
there add up to one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import need_columns
from vintageline.models.hazard import AGE, HazardModel, fit_hazards
from vintageline.settings import FEATURES, TARGET_NEXT

CAUSES = ("default", "prepaid", "repurchased", "other_exit")


def exit_next_month(panel: DataFrame, name: str = "EXIT_NEXT_MONTH") -> DataFrame:
    """Adds the cause that ends the loan in the next month, 'none' where it stays, NULL where that is not known."""
    need_columns(panel, ("ACT_PERIOD", "EXIT_DATE", "EXIT_TYPE", TARGET_NEXT), "next exits")
    ended = F.col("EXIT_DATE") == F.add_months("ACT_PERIOD", 1)
    return panel.withColumn(
        name, F.when(ended, F.col("EXIT_TYPE")).when(F.col(TARGET_NEXT).isNotNull(), "none")
    )


def cause_hazards(panel: DataFrame, by: Sequence[str] = (), age: str = AGE) -> DataFrame:
    """Loans at risk and exits by cause per loan age, and per group; one map-side-combined aggregate."""
    known = exit_next_month(panel, "_exit").where(F.col("_exit").isNotNull() & F.col(age).isNotNull())
    return known.groupBy(*by, F.col(age).alias("age")).agg(
        F.count(F.lit(1)).alias("at_risk"), *(F.count_if(F.col("_exit") == c).alias(c) for c in CAUSES)
    )


def _chained(months: Column) -> Column:
    """Incidence of each cause over an ordered array of monthly hazards, and the share that stays."""
    start = F.struct(F.lit(1.0).alias("survival"), *(F.lit(0.0).alias(c) for c in CAUSES))

    def step(so_far: Column, month: Column) -> Column:
        leaving = sum((month[c] for c in CAUSES), F.lit(0.0))
        return F.struct(
            (so_far["survival"] * F.greatest(1 - leaving, F.lit(0.0))).alias("survival"),
            *((so_far[c] + so_far["survival"] * month[c]).alias(c) for c in CAUSES),
        )

    return F.aggregate(months, start, step)


def competing_incidence(hazards: DataFrame, horizon: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Per age: incidence of each cause over the horizon and over all observed later ages, from loans alive then.

    Input as of ``cause_hazards``. An age without a row has no exits. A group holds one row per age in months, so the
    windows and their arrays stay within the longest term.
    """
    ahead = Window.partitionBy(*by).orderBy("age")
    rates = F.struct(*((F.col(c) / F.col("at_risk")).alias(c) for c in CAUSES))
    frames = {"horizon": horizon - 1, "lifetime": Window.unboundedFollowing}
    chained = hazards.withColumn("_rates", rates).withColumns(
        {f"_{n}": F.collect_list("_rates").over(ahead.rangeBetween(0, last)) for n, last in frames.items()}
    ).withColumns({f"_{n}": _chained(F.col(f"_{n}")) for n in frames})
    return chained.select(
        *by, "age", "at_risk", *CAUSES,
        *(F.col(f"_{n}.{c}").alias(f"{c}_{n}") for n in frames for c in ("survival", *CAUSES)),
    )


def fit_cause_hazards(
    panel: DataFrame, causes: Sequence[str] = CAUSES[1:], features: Sequence[str] = FEATURES, targets: Sequence[str] = ()
) -> dict[str, HazardModel]:
    """One hazard per cause on rows whose next month is known; a cause that never occurs has none.

    ``targets`` are columns of 0 and 1 that are fitted on the same rows beside them, under their own names.
    """
    known = exit_next_month(panel, "_exit").where("_exit IS NOT NULL")
    seen = known.agg(*(F.count_if(F.col("_exit") == c).alias(c) for c in causes)).first()
    found = [c for c in causes if seen[c]]
    if not found and not targets:
        return {}
    labels = {f"_target{i}": (F.col("_exit") == c).cast("int") for i, c in enumerate(found)}
    models = fit_hazards(known.withColumns(labels) if labels else known, (*targets, *labels), features)
    return dict(zip((*targets, *found), models))
