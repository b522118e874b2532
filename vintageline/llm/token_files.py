"""Token ids in ORC files (operator 10).

Documents are dealt into ascending ranges of doc_id (nulls first, equal ids in the order of reading) and
sorted inside each; the task that holds a range encodes its texts in that order and writes them as one ORC
file. A row is a document: doc_id, shard, start_in_shard, n_tokens and ids, an integer list that ORC stores
in run-length encoded stripes. Stripes carry row indexes and a Bloom filter on doc_id, so a reader splits
files at stripes and skips stripes, and row groups of them, by metadata alone. Only the texts cross a
shuffle, never the ids, and a hot source or a third of equal texts is spread like any other rows.

A null or empty text has only the end id. Repeated rows and repeated doc_ids are documents of their own.
An empty table writes no row and reads back as none. Other columns are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintageline.llm.common import shared_folder, slices
from vintageline.llm.tokens import worker_encoder

ROW_TYPE = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>"
END_ID = 1
# Words that a worker remembers; this sets only speed and memory.
REMEMBERED_WORDS = 500_000


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    stripe_bytes: int = 16 << 20,
    rows_per_index: int = 1000,
) -> None:
    """Encode ``documents`` (doc_id, text) and write them to a new folder ``path``."""
    row = F.monotonically_increasing_id().alias("_row")
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row").asc()]
    ranged = (
        documents.select("doc_id", "text", row).repartitionByRange(*order).sortWithinPartitions(*order)
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, done = worker_encoder(tokenizer, REMEMBERED_WORDS), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1000):
            ids, ends = encoder.encode(batch.column("text"))
            with_end = np.insert(ids, ends, end_id).astype(np.int32)
            limits = np.concatenate([[0], ends + np.arange(1, batch.num_rows + 1)])
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(np.full(batch.num_rows, shard, np.int32)),
                pa.array(done + limits[:-1]),
                pa.array(np.diff(limits)),
                pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(with_end)),
            ]
            done += int(limits[-1])
            names = ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    options = {
        "compression": "lz4",
        "orc.stripe.size": stripe_bytes,
        "orc.row.index.stride": rows_per_index,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": 0.01,
    }
    ranged.mapInArrow(encode, ROW_TYPE).write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with ``start``: the ids of all documents before each. Filters on doc_id prune stripes.

    One total per file is accumulated in one window and sent to all tasks; there are as many as the
    session's shuffle partitions at the time of writing, so ids never move.
    """
    rows = spark.read.schema(ROW_TYPE).orc(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard")
        .agg(F.sum("n_tokens").alias("_in_shard"))
        .select("shard", F.coalesce(F.sum("_in_shard").over(before), F.lit(0)).alias("_offset"))
    )
    start = (F.col("_offset") + F.col("start_in_shard")).alias("start")
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", start, "n_tokens", "ids")


def id_checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    for batch in batches:
        ids = batch.column("ids")
        values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_file_digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder, read them back and describe each document."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents, path, tokenizer)
    stored = read_token_files(spark, path)
    return stored.mapInArrow(id_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
