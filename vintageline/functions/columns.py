"""Row-local column expressions: code labels, delinquency, scores, quarters, weighted means."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# Labels of the coded fields.
CODE_LABELS = {
    "CHANNEL": {"B": "Broker", "C": "Correspondent", "R": "Retail"},
    "PURPOSE": {
        "C": "Cash-out refinance",
        "P": "Purchase",
        "R": "Rate-term refinance",
        "U": "Unknown",
    },
    "PROP": {
        "CO": "Condominium",
        "CP": "Cooperative",
        "MH": "Manufactured housing",
        "PU": "Planned unit development",
        "SF": "Single-family",
    },
    "OCC_STAT": {"I": "Investment", "P": "Primary residence", "S": "Second home", "U": "Unknown"},
    "ZERO_BAL_CODE": {
        "01": "Prepaid or matured",
        "02": "Third-party sale",
        "03": "Short sale",
        "06": "Repurchased",
        "09": "Deed-in-lieu",
        "15": "Note sale",
        "16": "Reperforming loan sale",
    },
}
DELINQUENCY_CODES = {"RA": "REO acquisition", "XX": "Unknown"}
SEVERE_MONTHS = 6


def need_columns(frame: DataFrame, names: Iterable[str], what: str) -> None:
    """Refuse a frame that lacks columns, naming them in sorted order (PRJ14)."""
    absent = sorted(set(names) - set(frame.columns))
    if absent:
        raise ValueError(f"{what} needs columns that are absent: {absent}")


CARRIED = "_carried"


def carry(frame: DataFrame, keep: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The frame with all columns but ``keep`` in one struct, and the names of these.

    Joins, windows and sorts of a wide table then copy a row's other columns as one value, not one by one.
    """
    rest = [c for c in frame.columns if c not in set(keep)]
    if not rest:
        return frame, rest
    return frame.select(*(c for c in frame.columns if c not in rest), F.struct(*rest).alias(CARRIED)), rest


def unfold(
    frame: DataFrame, rest: Iterable[str], order: Iterable[str], empty: Mapping[str, DataType] | None = None
) -> DataFrame:
    """The carried columns in their places again; a column made anew since then replaces the carried one.

    ``empty`` has columns by type that were left behind, as they hold NULL only."""
    made = [c for c in frame.columns if c != CARRIED]
    left = {c: F.lit(None).cast(kind) for c, kind in (empty or {}).items()}
    gone = {*rest, *left}
    back = {c: F.col(CARRIED)[c].alias(c) for c in rest if c not in made}
    back |= {c: value.alias(c) for c, value in left.items() if c not in made}
    first = [c for c in order if c in back or (c in made and c not in gone)]
    return frame.select(*(back.get(c, c) for c in first), *(c for c in made if c not in first))


def empty_columns(frame: DataFrame, names: Iterable[str]) -> list[str]:
    """Which of the columns hold NULL in every row; one pass."""
    names = list(names)
    filled = frame.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(names))).first() if names else ()
    return [c for c, n in zip(names, filled) if n == 0]


def code_label(code: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code, ``Unmapped (code)`` when unknown, NULL for a NULL code."""
    lookup = F.create_map(*(F.lit(part) for pair in labels.items() for part in pair))
    return F.coalesce(lookup[code], F.concat(F.lit("Unmapped ("), code, F.lit(")")))


def months_delinquent(status: Column) -> Column:
    """Delinquent months of an all-digit status; NULL for codes such as ``XX``."""
    return F.when(status.rlike(r"^\d+$"), status.try_cast("int"))


def delinquency_label(status: Column) -> Column:
    """Days-past-due label from the month count, so padded and bare codes read alike."""
    months = months_delinquent(status)
    numeric = (
        F.when(months == 0, "Current")
        .when(months >= SEVERE_MONTHS, f"{SEVERE_MONTHS * 30}+ days delinquent")
        .when(months.isNotNull(), F.concat((months * 30).cast("string"), F.lit(" days delinquent")))
    )
    return F.coalesce(numeric, code_label(status, DELINQUENCY_CODES))


def lowest_score(borrower: Column | str, coborrower: Column | str) -> Column:
    """Lower of two scores; ``least`` skips a missing one."""
    return F.least(borrower, coborrower)


def source_quarter(file_name: Column) -> Column:
    """``yyyyQn`` from a file name, any case, optional ``.csv``; NULL when it does not parse."""
    found = F.regexp_extract(file_name, r"(?i)^(\d{4}q[1-4])(?:\.csv)?$", 1)
    # Digits and one letter: translating it costs far less per row than upper-casing by locale rules.
    return F.translate(F.when(found != "", found), "q", "Q")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the weight of rows where both are present (AGG2)."""
    v, w = value.cast("double"), weight.cast("double")
    both = v.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w)))


def hex_bucket(key: Column, buckets: int) -> Column:
    """Stable bucket of a text key from its md5, reproducible in any SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
