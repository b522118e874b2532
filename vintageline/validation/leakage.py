"""Temporal-invariance check (VAL6): which columns change when later rows are withheld."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.settings import OUTCOME_COLUMNS


class LeakageError(ValueError):
    """A column outside the outcome registry depends on later rows."""


def changed_cells(
    build: Callable[[DataFrame], DataFrame],
    source: DataFrame,
    cutoff,
    keys: Sequence[str] = ("LOAN_ID", "ACT_PERIOD"),
    month: str = "ACT_PERIOD",
) -> DataFrame:
    """Build from all rows and from rows up to the cutoff; count differing cells per column.

    Compared are the row keys present in both builds, since a withheld exit may add rows.
    """
    known = F.col(month) <= F.lit(cutoff)
    full, early = build(source).where(known), build(source.where(known))
    columns = [c for c in full.columns if c not in keys]
    paired = full.select(*keys, F.struct(*columns).alias("f")).join(
        early.select(*keys, F.struct(*columns).alias("e")), list(keys)
    )
    counted = paired.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        *(F.count_if(~F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}"))).alias(c) for c in columns),
    )
    cells = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("changed_rows")) for c in columns)
    )
    return counted.select("rows_compared", F.inline(cells))


def require_no_leakage(changes: DataFrame, outcomes: Sequence[str] = OUTCOME_COLUMNS) -> list[str]:
    """Raise when a changed column is not a registered outcome; returns the changed columns."""
    changed = sorted(r.column_name for r in changes.where("changed_rows > 0").collect())
    leaking = sorted(set(changed) - set(outcomes))
    if leaking:
        raise LeakageError(f"columns depend on later rows: {leaking}")
    return changed
