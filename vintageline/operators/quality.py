"""Quality gate of the loan-month table (Q1-Q9, Q11): one row per expectation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PASSED, FAILED, ERRORED = "passed", "failed", "errored"

NOT_NULL = ("LOAN_ID", "ACT_PERIOD", "_source_file", "_source_sha256")
KEY = ("LOAN_ID", "ACT_PERIOD")
# Two digits, or the code for unknown.
STATUS_DOMAIN = r"^([0-9]{2}|XX)$"
REPORT_SCHEMA = (
    "expectation string, column_name string, observed_rows bigint, unexpected_rows bigint, status string"
)


class QualityError(RuntimeError):
    """The gate blocks publication; ``report`` lists every expectation that did not pass."""

    def __init__(self, report: list) -> None:
        self.report = report
        super().__init__(
            "quality gate: "
            + "; ".join(f"{r.expectation}[{r.column_name}] {r.status}, {r.unexpected_rows} rows" for r in report)
        )


def _bad_rows() -> list[tuple[str, str, Column]]:
    """Expectation, column and the predicate of an unexpected row; NULL values pass range and domain."""
    checks = [("not_null", c, F.col(c).isNull()) for c in NOT_NULL]
    checks.append(("above_zero", "ORIG_UPB", F.col("ORIG_UPB") <= 0))
    checks.append(("at_least_zero", "CURRENT_UPB", F.col("CURRENT_UPB") < 0))
    checks.append(("in_domain", "DLQ_STATUS", ~F.col("DLQ_STATUS").rlike(STATUS_DOMAIN)))
    return checks


def repeated_key_rows(frame: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows share their key with another row (Q6)."""
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unexpected_rows"))
    )


def quality_report(frame: DataFrame) -> DataFrame:
    """Evaluate every expectation: one narrow scan for row rules, one keyed count for uniqueness.

    A check whose column is absent is reported as errored, apart from data failures.
    """
    ready, broken = [], []
    for rule, column, bad in _bad_rows():
        (ready if column in frame.columns else broken).append((rule, column, bad))
    row_count = F.count(F.lit(1))
    cells = [("row_count", None, row_count, F.when(row_count < 1, 1).otherwise(0))]
    cells += [(rule, column, row_count, F.count_if(bad)) for rule, column, bad in ready]
    structs = F.array(
        *(
            F.struct(
                F.lit(rule).alias("expectation"),
                F.lit(column).cast("string").alias("column_name"),
                seen.alias("observed_rows"),
                bad.cast("bigint").alias("unexpected_rows"),
            )
            for rule, column, seen, bad in cells
        )
    )
    report = frame.agg(structs.alias("cells")).select(F.inline("cells"))
    if set(KEY) <= set(frame.columns):
        unique = repeated_key_rows(frame, *KEY).select(
            F.lit("unique_key").alias("expectation"),
            F.lit(",".join(KEY)).alias("column_name"),
            F.lit(None).cast("bigint").alias("observed_rows"),
            "unexpected_rows",
        )
        report = report.unionByName(unique)
    else:
        broken.append(("unique_key", ",".join(KEY), None))
    verdict = F.when(F.col("unexpected_rows") > 0, FAILED).otherwise(PASSED)
    report = report.withColumn("status", verdict)
    if broken:
        spark = frame.sparkSession
        absent = spark.createDataFrame(
            [(rule, column, None, None, ERRORED) for rule, column, _ in broken], REPORT_SCHEMA
        )
        report = report.unionByName(absent)
    return report


def require_quality(frame: DataFrame) -> list:
    """Evaluate the gate; return its rows, or raise with those that did not pass."""
    rows = quality_report(frame).collect()
    open_rows = [r for r in rows if r.status != PASSED]
    if open_rows:
        raise QualityError(open_rows)
    return rows
