"""Removing repeated passages (operator 8) by longest-previous-factor arrays.

Texts are UTF-8 bytes; a string of ``WIDTH`` bytes that also starts earlier (in a smaller doc_id, or before in
the same document) is a copy, and every byte that a copy covers is removed. Suffixes of different texts
are brought together without sorting all of them:

1. Every WIDTH-byte string has an anchor, its ``GRAM``-byte substring of smallest hash (leftmost of equals), which
   depends on its bytes alone: equal strings have equal anchors. Neighbouring strings with the same anchor
   form a segment. Segments are sorted by anchor. Anchors that occur once hold no copy.
2. Of equal segments the first stays open and the others are copies as a whole; those of some thousand
   texts are settled before the sort, so a very common passage sends few rows to the task that gathers it.
3. Open segments of one anchor are fetched and their suffixes sorted. In that suffix array the previous and
   the next suffix that start earlier give the longest previous factor of each, and one of WIDTH bytes makes its
   string a copy. An anchor with more than ``GROUP`` open segments is not brought together; its strings are
   compared by 128-bit hashes, the first of each by a minimum that is combined before it is shuffled.
4. Runs of removed bytes are the union of all copies of a document.

Equal texts are one class before all that: but for the first, they are copies as a whole. The texts themselves
are written once, in buckets by document, so neither fetching nor cutting shuffles them. Segments and anchors
are told apart by 64-bit hashes each.

A null or empty text, or one of less than WIDTH bytes, loses nothing. Repeated doc_ids and null ones (they come
first) are documents of their own, earlier ones being those read first. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.llm.common import materialize, shared_folder, slices

WIDTH = 100
GRAM = 32
GROUP = 2000
# Bytes of one piece of a very long text; pieces overlap, so that no string is missed.
PIECE = 1 << 23
POSITION = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on, by joining hashes of halves."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    reach = 1
    while reach < GRAM:
        h = h[:-reach] * np.uint64(0xBF58476D1CE4E5B9) + h[reach:] * np.uint64(0x94D049BB133111EB) + np.uint64(reach)
        h ^= h >> np.uint64(31)
        reach *= 2
    return h * _MIX


def segments_of(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hashes, starts and ends of the segments, piece by piece."""
    for at in range(0, max(1, len(text) - WIDTH + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[at : at + PIECE + WIDTH - 1]
        if len(data) < WIDTH:
            return
        hashes = gram_hashes(data)
        lowest = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        # Smallest over the grams of each string, by doubling the span and closing with an overlap.
        span, grams = 1, WIDTH - GRAM + 1
        while span * 2 <= grams:
            lowest = np.minimum(lowest[:-span], lowest[span:])
            span *= 2
        if span < grams:
            rest = grams - span
            lowest = np.minimum(lowest[:-rest], lowest[rest:])
        place = (lowest & POSITION).astype(np.int64)
        starts = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
        ends = np.concatenate([starts[1:], [len(place)]]) + WIDTH - 1
        yield hashes[place[starts]].view(np.int64), at + starts, at + ends


def longest_previous_factors(strings: Sequence[bytes]) -> np.ndarray:
    """For each of equally long strings, in the order of their starts: the longest prefix that begins an earlier one."""
    count, width = len(strings), len(strings[0]) if strings else 0
    suffixes = sorted(range(count), key=strings.__getitem__)
    table = np.frombuffer(b"".join(strings[i] for i in suffixes), np.uint8).reshape(count, width)
    differs = table[1:] != table[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width).tolist()
    factors = np.zeros(count, np.int64)
    # Suffixes whose next smaller position is not met yet, each with what it shares with its previous smaller one.
    waiting: list[tuple[int, int]] = []
    for place, start in enumerate([*suffixes, -1]):
        shared = common[place - 1] if 0 < place < count else 0
        while waiting and start < waiting[-1][0]:
            held, before = waiting.pop()
            factors[held] = max(before, shared)
            shared = min(before, shared)
        waiting.append((start, shared))
    return factors


def _keyed(documents: DataFrame) -> DataFrame:
    """key, doc_id, text: a number per row in the order of doc_id; doc_id itself where that is one."""
    counts = documents.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    plain = documents.select(F.col("doc_id").cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if len(set(counts)) == 1:
        return plain
    rows = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "repeat-rows")
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ranged = rows.select("row", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    inside = materialize(ranged.select("row", F.monotonically_increasing_id().alias("number")), "repeat-keys")
    return rows.drop("key").join(inside, "row").select(F.col("number").alias("key"), "doc_id", "text")


def _stored(documents: DataFrame) -> DataFrame:
    """The keyed texts in a table of buckets by key, so that joins by key leave them where they are."""
    spark = documents.sparkSession
    name = f"repeat_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = _keyed(documents).write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "key").format("parquet").saveAsTable(name)
    return spark.table(name)


SEGMENT_TYPE = "anchor long, content long, key long, start long, size long, done boolean"
SEGMENT_NAMES = ["anchor", "content", "key", "start", "size"]


def _segment_rows(columns: Sequence[np.ndarray], done: bool) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(arrays[0]), done))], names=[*SEGMENT_NAMES, "done"])


def _segments(texts: DataFrame) -> DataFrame:
    """Segments of all texts. Of those that are equal within a few thousand texts only the first is compared
    further; the others are copies for certain and leave as runs, marked as done, spread by their document."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            parts = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                for anchors, starts, ends in segments_of(data):
                    digests = [
                        xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(starts.tolist(), ends.tolist())
                    ]
                    parts.append((anchors, np.array(digests, np.int64), np.full(len(anchors), key), starts, ends))
            if not parts:
                continue
            found = [np.concatenate([p[k] for p in parts]) for k in range(5)]
            order = np.lexsort((found[3], found[2], found[1], found[0]))
            anchor, content, key, start, end = (f[order] for f in found)
            again = np.zeros(len(anchor), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            yield _segment_rows([anchor[~again], content[~again], key[~again], start[~again], (end - start)[~again]], False)
            if again.any():
                key, start, end = key[again], start[again], end[again]
                order = np.lexsort((start, key))
                key, start, end = key[order], start[order], end[order]
                head = np.ones(len(key), bool)
                head[1:] = (key[1:] != key[:-1]) | (start[1:] > end[:-1])
                first = np.nonzero(head)[0]
                last = np.append(first[1:], len(key)) - 1
                run = [key[first], np.zeros(len(first)), key[first], start[first], end[last] - start[first]]
                yield _segment_rows(run, True)

    return texts.mapInArrow(cut, SEGMENT_TYPE)


def _sorted_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by (anchor, content, key, start): copies as a whole, and open ones with company."""
    last: tuple[int, int] | None = None
    first = None
    for batch in batches:
        done = batch.column("done")
        finished = batch.filter(done).select(SEGMENT_NAMES)
        closed = pa.array(np.zeros(finished.num_rows, bool))
        yield pa.RecordBatch.from_arrays([*finished.columns, closed], names=[*SEGMENT_NAMES, "open"])
        batch = batch.filter(pc.invert(done)).select(SEGMENT_NAMES)
        if not batch.num_rows:
            continue
        anchor, content = (batch.column(c).to_numpy() for c in ("anchor", "content"))
        new_anchor, new_content = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_content[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        if last is not None:
            new_anchor[0] = anchor[0] != last[0]
            new_content[0] = new_anchor[0] or content[0] != last[1]
        opened = np.zeros(len(anchor), bool)
        heads = np.nonzero(new_content)[0]
        if len(heads):
            leads = new_anchor[heads]
            company = np.append(~leads[1:], False)
            opened[heads] = ~leads | company
            if first is not None and not leads[0]:
                yield pa.RecordBatch.from_arrays([*first.columns, pa.array([True])], names=[*SEGMENT_NAMES, "open"])
            # The last head may yet get company from the next batch.
            first = batch.slice(int(heads[-1]), 1) if leads[-1] else None
        last = int(anchor[-1]), int(content[-1])
        kept = pa.array(opened | ~new_content)
        found = batch.filter(kept)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(opened).filter(kept)], names=[*SEGMENT_NAMES, "open"])


def _fetched(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """anchor, key, start, data: the bytes of the open segments."""
    wanted = opened.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("parts"))
    together = texts.select("key", "text").join(wanted, "key").select("key", "text", "parts")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = []
            for key, text, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "parts"))):
                data = text.encode()
                rows += [(p["anchor"], key, p["start"], data[p["start"] : p["start"] + p["size"]]) for p in parts]
            anchor, key, start, data = zip(*rows)
            columns = [*(pa.array(c, pa.int64()) for c in (anchor, key, start)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "key", "start", "data"])

    return together.mapInArrow(fetch, "anchor long, key long, start long, data binary")


RUN_TYPE = "key long, start long, end long"


def _run_rows(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in (keys, starts, ends)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "start", "end"])


def _by_factors(open_segments: DataFrame) -> DataFrame:
    """Copies among open segments, by longest previous factors; whole anchors at a time, several small ones together."""

    def copies(segments: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        segments.sort(key=lambda s: (s[1], s[2]))
        strings, keys, starts = [], [], []
        for _, key, start, data in segments:
            for k in range(len(data) - WIDTH + 1):
                strings.append(data[k : k + WIDTH])
                keys.append(key)
                starts.append(start + k)
        found = longest_previous_factors(strings) >= WIDTH
        key, start = np.array(keys, np.int64)[found], np.array(starts, np.int64)[found]
        return _run_rows(key, start, start + WIDTH)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "start", "data"))):
                if size > 200_000 and row[0] != held[-1][0]:
                    yield copies(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield copies(held)

    together = open_segments.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(search, RUN_TYPE)


def _by_hashes(open_segments: DataFrame) -> DataFrame:
    """Copies among open segments of crowded anchors, by hashes of their strings."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = []
            for key, start, data in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "data"))):
                for k in range(len(data) - WIDTH + 1):
                    rows.append((xxhash.xxh3_128_digest(data[k : k + WIDTH]), key, start + k))
            digest, key, start = zip(*rows)
            columns = [pa.array(digest, pa.binary()), pa.array(key, pa.int64()), pa.array(start, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "key", "start"])

    strings = open_segments.mapInArrow(hashed, "digest binary, key long, start long")
    firsts = strings.groupBy("digest").agg(F.min(F.struct("key", "start")).alias("first"))
    later = strings.join(firsts, "digest").where(F.struct("key", "start") != F.col("first"))
    return later.select("key", "start", (F.col("start") + WIDTH).alias("end"))


def _copies(texts: DataFrame) -> DataFrame:
    """key, start, end: bytes that copies cover, for texts of which no two are equal."""
    found = _segments(texts).repartition("anchor").sortWithinPartitions("anchor", "content", "key", "start")
    kept = materialize(found.mapInArrow(_sorted_out, SEGMENT_TYPE.replace("done", "open")), "repeat-segments")
    whole = kept.where("NOT open").select("key", "start", (F.col("start") + F.col("size")).alias("end"))
    opened = kept.where("open").select("anchor", "key", "start", "size")
    crowd = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("company")).where(F.col("company") > GROUP)
    crowd = materialize(crowd.select(F.col("anchor").alias("crowded")), "repeat-crowded")
    same = F.col("anchor") == F.col("crowded")
    few = _fetched(opened.join(crowd, same, "left_anti"), texts)
    many = _fetched(opened.join(crowd, same, "left_semi"), texts)
    return whole.union(_by_factors(few)).union(_by_hashes(many))


def without_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, data (its bytes), removed (list of start, end), kept (the other bytes)."""
    texts = _stored(documents)
    prints = texts.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("print"), F.octet_length("text").alias("size"))
    firsts = prints.groupBy("print").agg(F.min("key").alias("first"))
    # A text is looked at if it is the first of its class and long enough.
    later = prints.join(firsts, "print").where("key <> first")
    later = materialize(later.select("key", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")), "repeat-copies")
    looked_at = texts.where(F.octet_length("text") >= WIDTH).join(later.select("key"), "key", "left_anti")
    everything = later.where(F.col("end") >= WIDTH).union(_copies(looked_at))
    removed = everything.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    joined = texts.join(removed, "key", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            data, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                whole, joined, rest, at = text.encode(), [], [], 0
                for span in spans or ():
                    if joined and span["start"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], span["end"])
                    else:
                        joined.append(dict(span))
                for span in joined:
                    rest.append(whole[at : span["start"]])
                    at = span["end"]
                data.append(whole)
                removed.append(joined)
                kept.append(b"".join([*rest, whole[at:]]))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(data, pa.binary()), pa.array(removed, spans_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "data", "removed", "kept"])

    spans = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")]))
    result_type = joined.select("doc_id").schema.add("data", "binary").add("removed", spans).add("kept", "binary")
    return joined.mapInArrow(cut, result_type)


def repeats_digest(documents: DataFrame) -> DataFrame:
    cut = without_repeats(documents)
    covered = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r.end - r.start)
    return cut.select(
        "doc_id",
        F.octet_length("data").cast("long").alias("n_bytes"),
        covered.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
    SELECT doc_id, c * 256 AS base, substr(h, c * 512 + 1, {2 * (WIDTH + 255)}) AS part
    FROM d, unnest(range(len(h) // 512 + 1)) t(c)),
strings AS (
    SELECT doc_id, base + k AS i, substr(part, 2 * k + 1, {2 * WIDTH}) AS s
    FROM parts, unnest(range(256)) t(k) WHERE 2 * k + {2 * WIDTH} <= len(part)),
copies AS (
    SELECT doc_id, i FROM strings
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
headed AS (
    SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WIDTH}, true)::INT AS head FROM copies),
numbered AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM headed),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {WIDTH} AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL
    SELECT d.doc_id, coalesce(max(s.b), 0), max(len(h)) // 2 FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (
    SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS k
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed,
       coalesce(t.n, 0)::BIGINT AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN totals t USING (doc_id)
"""
