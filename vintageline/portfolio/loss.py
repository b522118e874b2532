"""PD term structure, LGD, staging and expected credit loss.

Choices where the design leaves room: a significant increase in risk is a PD at least twice the PD at
the loan's first scored month, with 30 days past due as the backstop; three months past due is
impaired; LGD falls back to a labelled constant where loss fields hold nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import months_delinquent
from vintageline.models.hazard import AGE, HazardModel

# Parts of log-odds are held within this size, so that their exponentials are finite.
MOST_LOGIT = 300.0
SICR_RATIO = 2.0
BACKSTOP_MONTHS = 1
IMPAIRED_MONTHS = 3
ASSUMED_LGD = 0.40
SCENARIOS = {"base": 1.0, "gfc": 2.5, "covid": 1.5}

COST_FIELDS = (
    "FORECLOSURE_COSTS", "PROPERTY_PRESERVATION_AND_REPAIR_COSTS", "ASSET_RECOVERY_COSTS",
    "MISCELLANEOUS_HOLDING_EXPENSES_AND_CREDITS", "ASSOCIATED_TAXES_FOR_HOLDING_PROPERTY",
)
PROCEEDS_FIELDS = (
    "NET_SALES_PROCEEDS", "CREDIT_ENHANCEMENT_PROCEEDS", "REPURCHASES_MAKE_WHOLE_PROCEEDS",
    "OTHER_FORECLOSURE_PROCEEDS",
)


def hazard_by_age(rows: DataFrame, event: str, age: str = AGE) -> DataFrame:
    """Empirical monthly hazard per loan age."""
    return (
        rows.where(F.col(event).isNotNull() & F.col(age).isNotNull())
        .groupBy(F.col(age).alias("age"))
        .agg(F.count(F.lit(1)).alias("at_risk"), F.sum(F.col(event).cast("bigint")).alias("events"))
        .withColumn("hazard", F.col("events") / F.col("at_risk"))
    )


def term_structure(hazards: DataFrame, horizon: int = 12) -> DataFrame:
    """PD over the horizon and over the observed life, chained from monthly survival.

    One row per loan age in months, so the unpartitioned windows stay within the longest term.
    """
    ahead = Window.orderBy("age")
    log_survival = F.ln(1 - F.least(F.col("hazard"), F.lit(1 - 1e-12)))
    return (
        hazards.withColumn("_ls", log_survival)
        .withColumn("survival_month", 1 - F.col("hazard"))
        .withColumn("pd_horizon", 1 - F.exp(F.sum("_ls").over(ahead.rangeBetween(0, horizon - 1))))
        .withColumn(
            "pd_lifetime", 1 - F.exp(F.sum("_ls").over(ahead.rangeBetween(0, Window.unboundedFollowing)))
        )
        .drop("_ls")
    )


def model_term_structure(
    rows: DataFrame,
    hazard: HazardModel,
    horizon: int = 12,
    remaining: str = "REM_MONTHS",
    competing: Sequence[HazardModel] = (),
) -> DataFrame:
    """Per loan-month: 12-month and lifetime PD by chaining the hazard over the loan's future ages.

    ``competing`` are the hazards of other exits, such as prepayment: the PD is then the incidence of default among
    loans that may also leave by them. Where the hazards of a month pass one together, they are scaled to one.

    A row's covariates stay fixed, so its log-odds are a constant plus a function of age. The age part is
    a short table over the fitted age range, held constant outside. Each Arrow batch walks the future
    months inside the range once for all its rows; the months past it, with equal hazards, are one geometric sum.
    No rows are multiplied and nothing moves between tasks.
    """
    models = (hazard, *competing)
    by_age, last_age = [], max(int(model.age_range[1]) for model in models)
    for model in models:
        low, high = (int(edge) for edge in model.age_range)
        ages = rows.sparkSession.range(low, high + 1)
        table = [r.f for r in ages.select(model.age_logit(F.col("id")).alias("f")).sort("id").collect()]
        by_age.append((low, np.exp(-np.clip(table, -MOST_LOGIT, MOST_LOGIT))))

    @F.pandas_udf("near double, life double")
    def chained(fixed: pd.DataFrame, age: pd.Series, left: pd.Series) -> pd.DataFrame:
        against = np.exp(-np.clip(fixed.to_numpy(dtype=float), -MOST_LOGIT, MOST_LOGIT))
        start = np.floor(age.to_numpy(dtype=float)).astype(int)
        months = left.to_numpy()

        def hazards(step: int) -> tuple[np.ndarray, np.ndarray]:
            """The hazard of default and that of any exit in the month of the step."""
            each = [
                1 / (1 + against[:, k] * table[np.clip(start - low + step, 0, len(table) - 1)])
                for k, (low, table) in enumerate(by_age)
            ]
            leaving = sum(each[1:], each[0])
            over = np.maximum(leaving, 1.0)
            return each[0] / over, leaving / over

        staying, lost, near = np.ones(len(months)), np.zeros(len(months)), np.zeros(len(months))
        # From this step on, every row is past the fitted ages.
        held = max(horizon, last_age - int(start.min(initial=last_age)))
        walked = min(held, int(months.max(initial=0)))
        for step in range(walked):
            default, leaving = hazards(step)
            open_ = step < months
            lost += np.where(open_, staying * default, 0.0)
            staying = np.where(open_, staying * (1 - leaving), staying)
            if step < horizon:
                near = lost.copy()
        default, leaving = hazards(walked)
        with np.errstate(divide="ignore", invalid="ignore"):
            gone = -np.expm1(np.maximum(months - walked, 0) * np.log1p(-leaving))
        return pd.DataFrame({"near": near, "life": lost + np.where(months > walked, staying * default / leaving * gone, 0.0)})

    left = F.greatest(F.coalesce(F.col(remaining).cast("int"), F.lit(0)), F.lit(0))
    age = F.coalesce(F.col(AGE).cast("double"), F.lit(hazard.medians[AGE]))
    fixed = F.struct(*(model.covariate_logit().alias(f"m{k}") for k, model in enumerate(models)))
    pds = chained(fixed, age, left)
    return (
        rows.withColumn("_pd", pds)
        .withColumns({"PD_12M": F.col("_pd.near"), "PD_LIFETIME": F.col("_pd.life")})
        .drop("_pd")
    )


def loss_given_default(
    liquidated: DataFrame,
    segments: Sequence[str] = (),
    assumed: float = ASSUMED_LGD,
    limits: tuple[float, float] = (0.0, 1.0),
) -> DataFrame:
    """Exposure plus costs minus proceeds over exposure, from the loss fields.

    Loans with neither costs nor proceeds carry no evidence; a group without evidence gets the
    assumed rate, and ``lgd_source`` says which it is. ``lgd`` is kept within ``limits``; ``raw_lgd`` is
    the rate before that, which costs above the exposure or gains can take beyond them. Loss fields that
    the frame lacks are listed in ``absent_fields`` and count as nothing.
    """
    costs = [c for c in COST_FIELDS if c in liquidated.columns]
    proceeds = [c for c in PROCEEDS_FIELDS if c in liquidated.columns]

    def total(names: Sequence[str]) -> Column:
        value = F.lit(0.0)
        for name in names:
            value = value + F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return value

    fields = costs + proceeds
    absent = ",".join(c for c in (*COST_FIELDS, *PROCEEDS_FIELDS) if c not in liquidated.columns)
    known = F.coalesce(*fields).isNotNull() if fields else F.lit(False)
    exposure = F.col("LAST_UPB").cast("double")
    usable = known & (exposure > 0)
    empirical = F.try_divide(
        F.sum(F.when(usable, exposure + total(costs) - total(proceeds))), F.sum(F.when(usable, exposure))
    )
    return (
        liquidated.groupBy(*segments)
        .agg(
            F.count(F.lit(1)).alias("liquidations"),
            F.count_if(usable).alias("with_loss_fields"),
            empirical.alias("empirical"),
        )
        .select(
            *segments, "liquidations", "with_loss_fields",
            F.when(F.col("empirical").isNull(), assumed)
            .otherwise(F.greatest(F.lit(limits[0]), F.least("empirical", F.lit(limits[1]))))
            .alias("lgd"),
            F.col("empirical").alias("raw_lgd"),
            F.lit(absent).alias("absent_fields"),
            F.when(F.col("empirical").isNull(), "assumed").otherwise("empirical").alias("lgd_source"),
        )
    )


def exposure_at_default(rows: DataFrame) -> DataFrame:
    """Current unpaid balance stands for the exposure (X11)."""
    return rows.withColumn("EAD", F.coalesce(F.col("CURRENT_UPB").cast("double"), F.lit(0.0)))


def assign_stage(scored: DataFrame, pd_column: str, ratio: float = SICR_RATIO) -> DataFrame:
    """Stage 1, 2 or 3 against the PD of the loan's first scored month.

    The first month is found in a window of the loan's rows, at most one per calendar month, so rows are scored once.
    """
    scored_month = F.when(F.col(pd_column).isNotNull(), F.col("ACT_PERIOD"))
    first = F.min_by(pd_column, scored_month).over(Window.partitionBy("LOAN_ID"))
    late = months_delinquent(F.col("DLQ_STATUS"))
    stage = (
        F.when(late >= IMPAIRED_MONTHS, 3)
        .when(late >= BACKSTOP_MONTHS, 2)
        .when(F.col(pd_column) >= ratio * F.col("PD_AT_ORIGINATION"), 2)
        .otherwise(1)
    )
    known = F.when(F.col("LOAN_ID").isNotNull(), first)
    ordered = scored.select("LOAN_ID", *(c for c in scored.columns if c != "LOAN_ID"))
    return ordered.withColumn("PD_AT_ORIGINATION", known).withColumn("STAGE", stage)


def expected_loss(
    staged: DataFrame,
    pd_12m: str,
    pd_lifetime: str,
    by: Sequence[str] = ("ACQUISITION_QUARTER", "STAGE"),
    lgd: Column | None = None,
    scenarios: Mapping[str, float] = SCENARIOS,
) -> DataFrame:
    """ECL per scenario, vintage and stage: PD (scaled, capped at 1) times LGD times EAD."""
    rate = F.lit(ASSUMED_LGD) if lgd is None else lgd
    pd_used = F.when(F.col("STAGE") == 1, F.col(pd_12m)).when(F.col("STAGE") == 2, F.col(pd_lifetime)).otherwise(1.0)
    table = F.array(
        *(
            F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("multiplier"))
            for n, m in scenarios.items()
        )
    )
    loss = F.least(F.col("_pd") * F.col("multiplier"), F.lit(1.0)) * F.col("_lgd") * F.col("EAD")
    return (
        exposure_at_default(staged)
        .select(*by, "EAD", pd_used.alias("_pd"), rate.alias("_lgd"), F.inline(table))
        .groupBy("scenario", *by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("EAD").alias("exposure"),
            F.sum(loss).alias("ecl"),
        )
        .withColumn("coverage", F.try_divide("ecl", "exposure"))
    )
