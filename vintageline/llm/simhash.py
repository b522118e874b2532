"""SimHash near-duplicates (operator 2): a tiled exact comparison of 64-bit fingerprints.

A fingerprint bit is set if more than half of the text's shingle hashes have it set. Texts with equal
fingerprints are one class; only distinct fingerprints are compared. They are sorted into tiles by the
population counts of their upper and lower halves. Two fingerprints within the radius differ in those
counts by no more than the radius in all, so other pairs of tiles are skipped unseen; tiles that remain are
compared in full by exclusive-or and bit counts in numpy. Tiles are cut into blocks of bounded size, and a
pair of blocks is the unit of work, so a crowded tile is spread over tasks. A pair of blocks returns a
spanning forest of its links, never the links of all members of a group with each other; components of
these forests are those of all links.

A null text has no words, like an empty one: fingerprint zero, linked like any other. Repeated rows keep
their own result rows. A null doc_id takes part, and names a component only if no other does. An empty
table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintageline.llm.common import free_name, materialize, row_hash, slices
from vintageline.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BLOCK = 4096


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text; bytes lower-case and split at exactly the ASCII letters and white space meant."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :])]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint's 64 bits as a long."""
    kept = [f"_k{i}" for i in range(len(keep))]
    read = documents.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), F.col("text").alias("_text"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([text_fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64)
            columns = [*(batch.column(k) for k in kept), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fp"])

    schema = read.select(*kept).schema.add("fp", "long")
    return read.mapInArrow(scan, schema).withColumnsRenamed(dict(zip(kept, keep)))


def tile_neighbours(radius: int) -> list[tuple[int, int]]:
    """Offsets to tiles within the radius, each pair of tiles once: the tile itself and those after it."""
    reach = range(-radius, radius + 1)
    return [(h, l) for h in reach for l in reach if abs(h) + abs(l) <= radius and (h, l) >= (0, 0)]


def forest(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what any pair of the two blocks within the radius connects."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = np.arange(len(nodes))
    of_left, of_right = place[: len(left)], place[len(left) :]
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        u, v = of_left[at + i], of_right[j]
        while True:
            lower = np.minimum(root[u], root[v])
            if (root[u] == lower).all() and (root[v] == lower).all():
                break
            # Roots are tied, not only the ends, so earlier links of either end come along.
            np.minimum.at(root, root[u], lower)
            np.minimum.at(root, root[v], lower)
            while not (root[root] == root).all():
                root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """a, b: links among the distinct values of column fp that connect all pairs within the radius."""
    halves = distinct.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
    )
    # At most 33 x 33 tiles.
    sizes = halves.groupBy("high", "low").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    blocks = (
        halves.join(F.broadcast(sizes), ["high", "low"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .groupBy("high", "low", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialize(blocks, "simhash-blocks")
    offsets = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(l).alias("l")) for h, l in tile_neighbours(radius)))
    reaching = blocks.select("*", F.explode(offsets).alias("step")).select(
        F.col("high").alias("own_high"),
        F.col("low").alias("own_low"),
        F.col("part").alias("own_part"),
        F.col("fps").alias("own"),
        (F.col("high") + F.col("step.h")).alias("high"),
        (F.col("low") + F.col("step.l")).alias("low"),
    )
    elsewhere = (F.col("own_high") != F.col("high")) | (F.col("own_low") != F.col("low"))
    pairs = (
        reaching.join(blocks, ["high", "low"])
        .where(elsewhere | (F.col("own_part") <= F.col("part")))
        .repartition("own_high", "own_low", "own_part", "high", "low", "part")
        .select("own", "fps")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            pairs = zip(batch.column("own"), batch.column("fps"))
            sides = ([np.asarray(x.values, np.int64).view(np.uint64) for x in pair] for pair in pairs)
            found = [forest(left, right, radius) for left, right in sides]
            ends = [np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, fp, and component_id: the smallest doc_id that links of fingerprints lead to."""
    columns = list(dict.fromkeys([*keep, "doc_id"]))
    rows = materialize(fingerprints(documents, columns), "simhash-fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(fingerprint_links(classes.select("fp"), radius))
    tied = classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = tied.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = tied.join(named, "component").select("fp", "component", "component_id")
    return rows.join(by_class, "fp").select(*keep, "fp", "component", "component_id")


def first_of_each(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each near-duplicate group, that of smallest doc_id (nulls last).

    Rows of one doc_id are told apart by a hash of all columns; equal rows are in one group anyway. The
    texts cross one shuffle and are not written.
    """
    name, key, found = (free_name(documents.columns, c) for c in ("_hash", "_key", "_found"))
    hashed = documents.withColumn(name, row_hash(documents))
    grouped = near_duplicates(hashed, radius, ["doc_id", name])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", name)
    first = grouped.groupBy("component").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.doc_id").alias(key), F.col(f"first.{name}").alias(found))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(name) == F.col(found))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).select(*documents.columns)


def simhash_digest(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    spelled = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", spelled.alias("fingerprint"), "component_id")
