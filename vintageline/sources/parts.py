"""Versioned tables of loan parts, so that a version can share unchanged parts with the one before.

A part is one directory that holds every row of its loans. A version's manifest lists its parts; a change
writes new parts for the loans it touches and names the directories of all others again. Nothing is
overwritten, so readers of earlier versions are not disturbed. Loans whose history is closed lie in parts
of their own, which monthly deliveries leave alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vintageline.sources.snapshots import commit_version, latest_version, manifest_row, materialize

PART = "PART"


@dataclass(frozen=True)
class Parts:
    """One version: its parts and where each lies ('' for a part without rows), its columns and its sources."""

    version: int
    places: dict[str, str]
    schema: StructType
    sources: dict[str, int]


def open_parts(spark: SparkSession, path: str, version: int | None = None) -> Parts | None:
    """A version of the table, the newest by default; None where nothing was published."""
    version = latest_version(spark, path) if version is None else version
    if version is None:
        return None
    row = manifest_row(spark, path, version)
    schema = StructType.fromJson(json.loads(row["columns"]))
    return Parts(version, json.loads(row["data"]), schema, json.loads(row["sources"]))


def read_parts(spark: SparkSession, path: str, table: Parts, names: Collection[str] | None = None) -> DataFrame:
    """Rows of the named parts, of all by default, with the part as a column; one scan, whatever their number."""
    schema = StructType([*table.schema.fields, StructField(PART, StringType())])
    places = [place for name, place in table.places.items() if place and (names is None or name in names)]
    if not places:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*places)
    return found.select(*schema.names)


def write_parts(rows: DataFrame, path: str, names: Collection[str] = ()) -> dict[str, str]:
    """Write rows by their part column; returns the place of each part, '' for those of ``names`` without rows.

    Rows are rebalanced by part, which spreads a large part over several tasks and files. What is written
    belongs to no version until ``commit_parts``.
    """
    base = f"{path}/data/w={uuid.uuid4().hex}"
    order = [c for c in ("LOAN_ID", "ACT_PERIOD") if c in rows.columns]
    rows.hint("rebalance", PART).sortWithinPartitions(PART, *order).write.partitionBy(PART).parquet(base)
    stored = rows.sparkSession.read.schema(StructType([StructField(PART, StringType())])).parquet(base)
    # One row per part, bounded by the manifest that names them.
    written = {row[0]: f"{base}/{PART}={row[0]}" for row in stored.distinct().collect()}
    return dict.fromkeys(names, "") | written


def commit_parts(
    spark: SparkSession, path: str, version: int, places: Mapping[str, str], schema: StructType, sources: Mapping[str, int]
) -> Parts:
    fields = StructType([f for f in schema.fields if f.name != PART])
    commit_version(spark, path, version, dict(sources), fields.jsonValue(), dict(places))
    return Parts(version, dict(places), fields, dict(sources))


def closed_loans(key: str, closing: Column) -> Column:
    """True in all rows of a loan one of whose rows meets ``closing``."""
    return F.max(F.coalesce(closing, F.lit(False))).over(Window.partitionBy(key))


def require_loan_months(incoming: DataFrame, keys: Collection[str]) -> None:
    """Refuse rows without a key and keys that come more than once."""
    empty = F.lit(False)
    for name in keys:
        empty = empty | F.col(name).isNull()
    broken = (
        incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(empty | (F.col("n") > 1)).agg(F.sum("n")).first()[0]
    )
    if broken:
        raise ValueError(f"{broken} rows lack one of {sorted(keys)} or share it")


def merge_parts(
    incoming: DataFrame,
    path: str,
    closing: Column,
    slots: int = 64,
    keys: tuple[str, str] = ("LOAN_ID", "ACT_PERIOD"),
) -> Parts:
    """Replace the loan-months in ``incoming``, keep all other rows, and publish the next version.

    Only the loan column of the table is scanned to find the parts that hold incoming loans; these alone are
    read whole and written again. A loan's rows go into one of ``slots`` parts by its hash, apart for loans
    with a ``closing`` row. Rows without a key, or two for one loan-month, are refused. A replay changes no row.
    """
    spark = incoming.sparkSession
    fresh = materialize(incoming, "merge-incoming")
    require_loan_months(fresh, keys)
    loan = keys[0]
    before = open_parts(spark, path)
    rows, kept = fresh, {}
    if before is not None:
        stored = read_parts(spark, path, before)
        # Neither side of these joins is bounded, and stored columns are far smaller than their rows: no broadcast.
        touched = stored.join(fresh.select(loan).distinct().hint("merge"), loan, "left_semi").select(PART).distinct()
        names = {row[0] for row in touched.collect()}
        kept = {name: place for name, place in before.places.items() if name not in names}
        old = read_parts(spark, path, before, names).drop(PART)
        rows = fresh.unionByName(old.join(fresh.select(*keys).hint("merge"), list(keys), "left_anti"))
    stamp = uuid.uuid4().hex[:8]
    state = F.when(closed_loans(loan, closing), "closed").otherwise("open")
    slot = F.pmod(F.xxhash64(loan), F.lit(slots)).cast("string")
    written = write_parts(rows.withColumn(PART, F.concat_ws("-", F.lit(stamp), state, slot)), path)
    version = 0 if before is None else before.version + 1
    places = kept | written
    return commit_parts(spark, path, version, places, rows.schema, {})
