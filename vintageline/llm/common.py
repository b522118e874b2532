"""Helpers shared by the operators: tables, written intermediates and small slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintageline.sources.snapshots import shared_folder

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once, packed tightly, under the folder that all executors share, and read it back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task builds from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``most`` bytes in a text column; a longer text is alone in its batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if total + size > most and row > start:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def is_training(key: str, modulo: int, held_out: int):
    """Whether crc32 of the key as text leaves another remainder than the held-out one; null keys train."""
    remainder = F.crc32(F.col(key).cast("string").cast("binary")) % modulo
    return F.coalesce(remainder != held_out, F.lit(True))


def row_hash(frame: DataFrame):
    """128 bits of all columns; rows that share them and an identifier are equal, and one may stand for another.

    Spark's hash passes over nulls, so each column is hashed together with whether it is null."""
    parts = [part for c in frame.columns for part in (F.col(c).isNull(), F.col(c))]
    return F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(seed), *parts)) for seed in (1, 2)))
