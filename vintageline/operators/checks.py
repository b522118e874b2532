"""Contract checks of raw records as distributed jobs (CHK1-CHK7).

Each check returns rows, so every violation of a file is listed by one job, a narrow map over the raw
rows without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintageline.sources.contract import (
    DEFAULT_WIDTH,
    DELIMITER,
    ContractError,
    Field,
    fields_of_width,
)

_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# What nearly all values look like, of each kind; whatever else they may look like, the full rules decide.
_PLAIN_INTEGER = r"^[0-9]+$"
_PLAIN_MONTH = r"^(0[1-9]|1[0-2])[1-9][0-9]{3}$"


def split_lines(lines: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Text lines to contract columns plus their field count; short lines leave NULL cells."""
    parts = F.split(F.rtrim("value", F.lit("\r\n")), "\\" + DELIMITER, -1)
    return (
        lines.withColumn("_cells", parts)
        .withColumn("FIELD_COUNT", F.size("_cells"))
        .select(
            *[c for c in lines.columns if c != "value"],
            "FIELD_COUNT",
            *(F.get("_cells", F.lit(f.position - 1)).alias(f.name) for f in fields_of_width(width)),
        )
    )


def is_integer(value: Column) -> Column:
    return value.rlike(_INTEGER)


def decimal_places(value: Column) -> Column:
    """Digits after the point once an exponent is applied; NULL when the text is no finite decimal."""
    mantissa = F.length(F.regexp_extract(value, r"\.([0-9]*)", 1))
    # Casting an empty text costs an exception, so only a text with an exponent is cast.
    power = F.when(value.rlike("[eE]"), F.regexp_extract(value, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"))
    exponent = F.coalesce(power, F.lit(0))
    return F.when(value.rlike(_DECIMAL), F.greatest(mantissa - exponent, F.lit(0)))


def is_month(value: Column) -> Column:
    return value.rlike(r"^[0-9]{6}$") & F.try_to_date(value, "MMyyyy").isNotNull()


def broken_rule(field: Field) -> Column:
    """Name of the rule that the field's non-empty value breaks, else NULL; only the patterns of its kind run."""
    value = F.col(field.name)
    rule = F.when(F.length(value) > field.max_length, "length") if field.max_length is not None else None
    if field.kind == "integer":
        broken = F.when(~is_integer(value), "integer")
    elif field.kind == "month":
        broken = F.when(~is_month(value), "month")
    else:
        places = decimal_places(value)
        broken = F.when(places.isNull(), "decimal").when(places > field.scale, "scale")
    return F.when(value != "", broken if rule is None else F.coalesce(rule, broken))


def _looks(field: Field) -> str:
    if field.kind == "integer":
        return _PLAIN_INTEGER
    return _PLAIN_MONTH if field.kind == "month" else rf"^[0-9]+(\.[0-9]{{0,{field.scale}}})?$"


def in_doubt(fields: Sequence[Field]) -> Column:
    """Whether a row has a value that one pattern, or its length, does not pass at sight."""
    groups: dict[tuple, list[str]] = {}
    for field in fields:
        groups.setdefault((_looks(field), field.max_length), []).append(field.name)
    found = F.lit(False)
    for (pattern, most), names in groups.items():
        found = found | F.exists(F.array(*names), lambda v: _unlike(v, pattern, most))
    return found


def _unlike(value: Column, pattern: str, most: int | None) -> Column:
    odd = ~value.rlike(pattern)
    return F.coalesce((value != "") & (odd if most is None else odd | (F.length(value) > most)), F.lit(False))


def violations(
    raw: DataFrame, fields: Sequence[Field], keys: Sequence[str] = ("LOAN_ID", "ACT_PERIOD")
) -> DataFrame:
    """One row per broken typed value: the row's keys, column, rule and value (CHK1-CHK4, CHK6).

    Each column has one fixed expression; only broken cells become rows. The full rules run on rows in doubt alone.
    The outer form keeps the optimizer from asking first, in a filter of its own, whether a row has broken cells.
    """
    checked = [f for f in fields if f.kind != "string" and f.name in raw.columns]
    kept = [F.col(k).alias(f"ROW_{k}") for k in keys if k in raw.columns]
    cells = F.array(
        *(
            F.struct(F.col(f.name).alias("value"), broken_rule(f).alias("rule"), F.lit(f.name).alias("column_name"))
            for f in checked
        )
    )
    broken = F.filter(cells, lambda cell: cell.rule.isNotNull())
    found = raw.select(*kept, F.inline_outer(F.when(in_doubt(checked), broken)))
    return found.where(F.col("rule").isNotNull())


def width_counts(lines: DataFrame, *by: str) -> DataFrame:
    """Lines per field count, per file where ``by`` names the file column (SRC4)."""
    width = F.size(F.split("value", "\\" + DELIMITER, -1)).alias("field_count")
    return lines.groupBy(*by, width).agg(F.count(F.lit(1)).alias("line_count"))


def require_valid(raw: DataFrame, width: int = DEFAULT_WIDTH) -> None:
    examples = violations(raw, fields_of_width(width)).limit(5).collect()
    if examples:
        raise ContractError(
            "raw values break the contract, such as "
            + ", ".join(f"{r.column_name}={r.value!r} ({r.rule})" for r in examples)
        )


def text_length_report(raw: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Text columns holding values over their declared length: limit, longest seen, rows over (CHK5).

    Over-long text is an observation for the owner of the data, not a parse failure.
    """
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(limit).alias("declared_length"),
                F.max(F.length(name)).alias("longest"),
                F.count_if(F.length(name) > limit).alias("rows_over"),
            )
            for name, limit in limits.items()
        )
    )
    return raw.agg(cells.alias("cells")).select(F.inline("cells")).where("rows_over > 0")


def declared_text_lengths(width: int = DEFAULT_WIDTH) -> dict[str, int]:
    return {f.name: f.max_length for f in fields_of_width(width) if f.max_length is not None}


def digit_report(raw: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Most integer digits seen per numeric column beside its declared digits; nothing fails (CHK7)."""

    def seen(name: str) -> Column:
        return F.length(F.regexp_extract(F.col(name).cast("string"), r"([0-9]+)", 1))

    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(limit).alias("declared_digits"),
                F.max(seen(name)).alias("most_digits"),
                F.count_if(seen(name) > limit).alias("rows_over"),
            )
            for name, limit in digits.items()
        )
    )
    return raw.agg(cells.alias("cells")).select(F.inline("cells"))


def declared_digits(width: int = DEFAULT_WIDTH) -> dict[str, int]:
    return {f.name: f.digits for f in fields_of_width(width) if f.digits is not None}
