"""Typed, deduplicated loan-months and the servicer history (PRJ1, PRJ2, WIN1-WIN4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.functions.columns import CODE_LABELS, carry, code_label, delinquency_label, need_columns, unfold
from vintageline.sources.contract import Field, all_fields


def typed_field(field: Field) -> Column:
    """Text column of a contract field as its logical type; malformed text fails the job."""
    value = F.col(field.name)
    if field.kind == "month":
        value = F.to_date(value, "MMyyyy")
    elif field.kind != "string":
        value = value.cast(field.spark_type)
    return value.alias(field.name)


def type_columns(bronze: DataFrame) -> DataFrame:
    """Cast the contract fields that are present, in one projection (PRJ1)."""
    contract = {f.name: f for f in all_fields()}
    return bronze.select(
        *(typed_field(contract[c]) if c in contract else F.col(c) for c in bronze.columns)
    )


def label_codes(typed: DataFrame) -> DataFrame:
    """Add ``<code>_LABEL`` columns for the coded fields and the delinquency status (PRJ2)."""
    labels = {
        f"{name}_LABEL": code_label(F.col(name), values)
        for name, values in CODE_LABELS.items()
        if name in typed.columns
    }
    labels["DLQ_STATUS_LABEL"] = delinquency_label(F.col("DLQ_STATUS"))
    return typed.withColumns(labels)


def keep_latest(frame: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: greatest ``newest`` columns, then greatest row hash so ties are stable (WIN1).

    A rank of one is pruned inside each map task before the shuffle, so a key that repeats without
    bound travels as one row per task. Columns that do not order the rows travel as one value.
    """
    need_columns(frame, (*keys, *newest), "keep latest")
    hashed = frame.withColumn("_hash", F.xxhash64(*sorted(frame.columns)))
    narrow, rest = carry(hashed, {*keys, *newest, "_hash"})
    order = [F.col(c).desc() for c in newest] + [F.col("_hash").desc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = narrow.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank", "_hash")
    return unfold(kept, rest, frame.columns)


def repeated_marks(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column _mark: 64-bit hashes of the keys that several rows have, and perhaps of a few others."""
    mark = F.xxhash64(*keys).alias("_mark")
    return frame.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_mark")


def keep_latest_marked(frame: DataFrame, keys: Sequence[str], newest: Sequence[str], marks: DataFrame) -> DataFrame:
    """The rows of ``keep_latest``, where ``marks`` has the hashes of all repeated keys and is small.

    Rows of other keys are alone and stay in their tasks; only marked ones are shuffled and ranked.
    """
    marked, few = frame.withColumn("_mark", F.xxhash64(*keys)), F.broadcast(marks)
    alone = marked.join(few, "_mark", "left_anti").drop("_mark")
    shared = marked.join(few, "_mark", "left_semi").drop("_mark")
    return alone.unionByName(keep_latest(shared, keys, newest))


MONTH_KEY = ("LOAN_ID", "ACT_PERIOD")
NEWEST_LOAD = ("_ingested_at", "_source_sha256")


def silver_table(bronze: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Typed, labelled, newest version of every loan-month.

    Duplicates go first, on the raw text, so only surviving rows are cast and labelled. Given the few ``marks`` of
    repeated loan-months, other rows are not shuffled.
    """
    if marks is None:
        survivors = keep_latest(bronze, MONTH_KEY, NEWEST_LOAD)
    else:
        survivors = keep_latest_marked(bronze, MONTH_KEY, NEWEST_LOAD, marks)
    return label_codes(type_columns(survivors))


def servicer_spells(silver: DataFrame) -> DataFrame:
    """Slowly changing loan-servicer assignments: a spell ends the month before the next begins.

    Works on three columns of a table with one row per loan and month, so a loan's window holds at most
    one row per calendar month.
    """
    need_columns(silver, ("LOAN_ID", "ACT_PERIOD", "SERVICER"), "servicer history")
    by_month = Window.partitionBy("LOAN_ID").orderBy("ACT_PERIOD")
    starts = (
        silver.select("LOAN_ID", "ACT_PERIOD", "SERVICER")
        .dropna()
        .withColumn("_before", F.lag("SERVICER").over(by_month))
        .where(~F.col("SERVICER").eqNullSafe(F.col("_before")))
    )
    return (
        starts.withColumn("_next", F.lead("ACT_PERIOD").over(by_month))
        .select(
            F.sha2(
                F.concat_ws("|", "LOAN_ID", "SERVICER", F.date_format("ACT_PERIOD", "yyyy-MM-dd")), 256
            ).alias("LOAN_SERVICER_KEY"),
            "LOAN_ID",
            "SERVICER",
            F.col("ACT_PERIOD").alias("EFFECTIVE_FROM"),
            F.add_months("_next", -1).alias("EFFECTIVE_TO"),
            F.col("_next").isNull().alias("IS_CURRENT"),
        )
    )


def numbered_spells(silver: DataFrame) -> DataFrame:
    """Loan-months with the running number of their servicer spell (WIN2, WIN3)."""
    by_month = Window.partitionBy("LOAN_ID").orderBy("ACT_PERIOD")
    changed = ~F.col("SERVICER").eqNullSafe(F.lag("SERVICER").over(by_month))
    running = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        silver.select("LOAN_ID", "ACT_PERIOD", "SERVICER")
        .dropna()
        .withColumn("NEW_SPELL", changed.cast("int"))
        .withColumn("SPELL_NUMBER", F.sum("NEW_SPELL").over(running))
    )
