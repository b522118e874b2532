"""Packing token ids into sequences (operator 6), balanced by attention cost.

Documents are encoded where they are read and dealt by hash into groups of a bounded number of tokens. A
group is packed by one task: each document is cut into whole sequences and a rest; the rests, longest
first, go to the sequence of lowest cost that still has room, where a piece costs a linear part for its
tokens and a quadratic part for its attention. A group gets as few sequences as its tokens need; a rest
that fits nowhere is cut to fill the rooms left. So a group pads less than one sequence in all.

The result has a row per piece: the document's columns, start and length of the piece, doc_tokens,
sequence_id, offset, and ids, little-endian unsigned 32-bit integers. Pieces of a sequence follow each
other without gaps from offset 0, and every id lies in one piece.

A null or empty text has only the end id, and so is one piece of length 1. Rows are packed as they are:
repeated rows and doc_ids are documents of their own, null identifiers stay null. Ties in length go to the
row read first, ties in cost to the smaller sequence. An empty table has no pieces. Of the other columns,
those named in ``keep`` come along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vintageline.llm.common import slices
from vintageline.llm.tokens import worker_encoder

SEQUENCE_TOKENS = 4096
SEPARATOR_ID = 2
# Price of attention for a sequence-long piece, relative to its linear cost.
QUADRATIC = 1.0
# Bytes of text per group; its ids take about as much memory.
GROUP_BYTES = 12_000_000


def piece_cost(length: int, capacity: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC) -> float:
    return length + quadratic * length * length / capacity


def place_pieces(
    lengths: Sequence[int], capacity: int = SEQUENCE_TOKENS
) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths, sequences from 0."""
    placed, rests, sequence = [], [], 0
    for document, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            placed.append((document, k * capacity, capacity, sequence + k, 0))
        sequence += whole
        if length % capacity:
            rests.append((length % capacity, document, whole * capacity))
    rests.sort(key=lambda r: -r[0])
    count = -(-sum(r[0] for r in rests) // capacity)
    filled = [0] * count
    open_by_cost = [(0.0, s) for s in range(count)]
    # Sequences without room for the rest at hand, by room: shorter rests may still fit.
    waiting: list[tuple[int, float, int]] = []
    left_over = []
    for length, document, start in rests:
        while waiting and -waiting[0][0] >= length:
            _, cost, s = heapq.heappop(waiting)
            heapq.heappush(open_by_cost, (cost, s))
        while open_by_cost and capacity - filled[open_by_cost[0][1]] < length:
            cost, s = heapq.heappop(open_by_cost)
            if filled[s] < capacity:
                heapq.heappush(waiting, (filled[s] - capacity, cost, s))
        if not open_by_cost:
            left_over.append((length, document, start))
            continue
        cost, s = open_by_cost[0]
        placed.append((document, start, length, sequence + s, filled[s]))
        filled[s] += length
        heapq.heapreplace(open_by_cost, (cost + piece_cost(length, capacity), s))
    rooms = sorted((s for s in range(count) if filled[s] < capacity), key=lambda s: filled[s])
    for length, document, start in left_over:
        while length:
            s = rooms[0]
            part = min(length, capacity - filled[s])
            placed.append((document, start, part, sequence + s, filled[s]))
            filled[s] += part
            start, length = start + part, length - part
            if filled[s] == capacity:
                rooms.pop(0)
    return placed


def packed(
    documents: DataFrame,
    tokenizer: str,
    keep: Sequence[str] = ("doc_id",),
    capacity: int = SEQUENCE_TOKENS,
    separator_id: int = SEPARATOR_ID,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The pieces of all documents: ``keep``, start, length, doc_tokens, sequence_id, offset, ids."""
    volume = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-volume // group_bytes))
    # Ids cross the shuffle in as few bytes as the vocabulary allows.
    ids_used = max(Tokenizer.from_file(tokenizer).get_vocab_size(), separator_id + 1)
    stored = np.dtype("<u2" if ids_used <= 1 << 16 else "<u4")
    kept = [f"_k{i}" for i in range(len(keep))]
    numbered = documents.select(
        *(F.col(c).alias(k) for c, k in zip(keep, kept)),
        F.col("text").alias("_text"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_group"),
    )
    encoded_type = numbered.drop("_text").schema.add("_ids", "binary")
    piece_type = numbered.select(*kept).schema
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        piece_type.add(name, "long")
    piece_type.add("ids", "binary")
    names = piece_type.fieldNames()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in slices(batches):
            ids, ends = encoder.encode(batch.column("_text"))
            small = np.insert(ids, ends, separator_id).astype(stored)
            limits = np.concatenate([[0], ends + np.arange(1, batch.num_rows + 1)])
            rows = [small[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]
            columns = [batch.column(c) for c in (*kept, "_group")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], names=[*kept, "_group", "_ids"])

    def pack(group: pa.Table) -> pa.Table:
        number = group.column("_group")[0].as_py()
        ids = group.column("_ids").to_pylist()
        lengths = [len(i) // stored.itemsize for i in ids]
        placed = place_pieces(lengths, capacity)
        taken = group.select(kept).take(pa.array([p[0] for p in placed], pa.int64()))
        numbers = [
            [p[1] for p in placed],
            [p[2] for p in placed],
            [lengths[p[0]] for p in placed],
            [(number << 32) + p[3] for p in placed],
            [p[4] for p in placed],
        ]
        wide = [np.frombuffer(i, stored).astype("<u4") for i in ids]
        cut = pa.array((wide[d][a : a + n].tobytes() for d, a, n, _, _ in placed), pa.binary())
        return pa.table([*taken.columns, *(pa.array(n, pa.int64()) for n in numbers), cut], names=names)

    pieces = numbered.mapInArrow(encode, encoded_type).groupBy("_group").applyInArrow(pack, piece_type)
    return pieces.withColumnsRenamed(dict(zip(kept, keep)))


def packing_digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    pieces = packed(documents.select("doc_id", "text"), tokenizer)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
