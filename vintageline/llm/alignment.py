"""Cross-tokenizer alignment (operator 12): two tokenizations of a text, cut where both end a token.

Equal texts are brought together by a shuffle on the full text and each distinct text is tokenised and aligned once.
Tokenizer A is a byte-level byte pair encoding (``tokenizers``), B a byte pair model with byte fallback
(``sentencepiece``). Both see a blank and the text. Neither joins a blank to what stands before it, so a text is
cut before each run of white space that begins with a blank, and a worker remembers tokens, groups and links of such
segments. A byte offset at which a token of A and one of B end closes a group and links these two tokens; no token is
empty, so a text has as many links as groups.

Pairs are counted over all documents, each distinct text weighted by its copies. Of the counts, the most frequent pairs,
at most ``most_pairs``, are sent to the tasks that measure the texts; rarer ones, if there are more, meet the texts
in a join. The measures go back to the documents by a digest of the text. A hot text is one row of the measures and an
ordinary sort-merge join, which adaptive execution splits.

A null or empty text, or one that the tokens of A or B do not spell exactly, has no tokens: zeros and no groups.
Repeated rows and identifiers have each their row; other columns are not needed. Ties of a count are all best. Empty
tables give no row. Long texts are aligned whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintageline.llm.common import byte_slices, materialize
from vintageline.llm.tokens import WordStore, byte_symbols, spread, utf8_bytes, worker_state

MOST_PAIRS = 500_000
REMEMBERED_SEGMENTS = 250_000
MOST_LOCAL_PAIRS = 2_000_000
_SAMPLE = " The quick  brown\n\n fox's \t 3rd jump—naïve, (over) 42 dogs!?\n  déjà vu 中文 "
ALIGNED_TYPE = (
    "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "pairs array<bigint>, times array<int>"
)


class Sides:
    """The two tokenizers and what their tokens spell."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
        self.bytes_a = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} joins blanks to what stands before them")
        alone = self.b.encode("x")
        self.blank = self.b.encode("x ")[len(alone) :]
        whole = self.encode([_SAMPLE])
        parts = self.encode(segments(pa.array([_SAMPLE]))[0].to_pylist())
        if any(w[0] != [i for part in p for i in part] for w, p in zip(whole, parts)):
            raise ValueError(f"{path_a} or {path_b} does not encode texts segment by segment")

    def encode(self, spelled: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for strings that begin with a blank; B adds its own."""
        found = [e.ids for e in self.a.encode_batch_fast(spelled, add_special_tokens=False)]
        return found, [i if s != " " else self.blank for s, i in zip(spelled, self.b.encode([s[1:] for s in spelled]))]


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts that begin with a blank, cut before every blank that stands behind other than white space; and the
    number of segments of each text."""
    data, bounds = utf8_bytes(texts)
    cut = data == 0x20
    # The three bytes before each byte.
    third, second, first = (np.concatenate([np.full(k, 0x20), data])[: len(data)] for k in (3, 2, 1))
    # White space beyond ASCII is U+0085, U+00A0 or three bytes that begin with E1, E2 or E3; a cut left out is no error.
    wide = ((second == 0xC2) & ((first == 0x85) | (first == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3))
    cut &= (first > 0x20) & (first != 0x7F) & ~wide
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.nonzero(cut)[0]
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return found, np.diff(np.searchsorted(starts, bounds))


class SegmentStore(WordStore):
    """Per segment: [tokens of A, tokens of B, whether both spell it, links as places of pairs], and its groups as text."""

    def __init__(self, sides: Sides, most_words: int = REMEMBERED_SEGMENTS):
        self.sides = sides
        self.groups: list[str] = []
        self.pair_place: dict[int, int] = {}
        super().__init__(self._learn, most_words, 12 * most_words)

    def kept(self, places: np.ndarray) -> None:
        self.groups = [self.groups[k] for k in places.tolist()]

    def _learn(self, spelled: list[str]) -> list[bytes]:
        found = []
        bytes_a, bytes_b, place = self.sides.bytes_a, self.sides.bytes_b, self.pair_place
        for text, a, b in zip(spelled, *self.sides.encode(spelled)):
            data = text.encode()
            spells_a, spells_b = [bytes_a[i] for i in a], [bytes_b[i] for i in b]
            if b"".join(spells_a) != data or b"".join(spells_b) != data:
                found.append(np.array([0, 0, 0], np.int32).tobytes())
                self.groups.append("")
                continue
            row, groups = [len(a), len(b), 1], []
            at_a = at_b = first_a = first_b = i = j = 0
            while i < len(a):
                at_a += len(spells_a[i])
                i += 1
                while at_b < at_a:
                    at_b += len(spells_b[j])
                    j += 1
                if at_a == at_b:
                    row.append(place.setdefault((a[i - 1] << 32) | b[j - 1], len(place)))
                    groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                    first_a, first_b = i, j
            found.append(np.array(row, np.int32).tobytes())
            self.groups.append(";".join(groups))
        return found

    def aligned(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts of A tokens, B tokens and groups, the groups, and each text's different pairs with their number."""
        if len(self.pair_place) > MOST_LOCAL_PAIRS:
            self.pair_place, self.groups = {}, []
            self._start([], np.zeros(0, np.int64), np.zeros(0, np.int32))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        cut, per_text = segments(pc.binary_join_element_wise(" ", texts, ""))
        coded = cut.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        places = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[at]
        starts, ends = self.ends[places], self.ends[places + 1]
        count = len(per_text)
        text = np.repeat(np.arange(count), per_text)
        good = (np.bincount(text, self.values[starts + 2] == 0, count) == 0) & ~empty
        links = (ends - starts - 3) * good[text]
        sums = [self.values[starts] * good[text], self.values[starts + 1] * good[text], links]
        counts = [np.bincount(text, x, count).astype(np.int64) for x in sums]
        limits = np.concatenate([[0], np.cumsum(per_text)])
        groups = [
            ";".join([self.groups[k] for k in places[a:b].tolist()]) if fine else ""
            for a, b, fine in zip(limits[:-1].tolist(), limits[1:].tolist(), good.tolist())
        ]
        pair = self.values[spread(starts + 3, links)].astype(np.int64)
        width = max(1, len(self.pair_place))
        found, times = np.unique(np.repeat(text, links) * width + pair, return_counts=True)
        names = np.fromiter(self.pair_place, np.int64, len(self.pair_place))
        return counts, groups, names[found % width] if len(found) else found, found // width, times


def _store(path_a: str, path_b: str) -> SegmentStore:
    kept = worker_state("segments")
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = SegmentStore(Sides(path_a, path_b))
    return kept[path_a, path_b]


def text_key(text):
    return F.unhex(F.sha2(text, 256))


def aligned_texts(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per distinct text: its key, copies, token counts, groups as ``a1,a2|b1;a3|b2`` and different pairs.

    A pair is A's id times 2**32 plus B's id; ``times`` has its links in the text."""
    Sides(path_a, path_b)
    text = F.coalesce("text", F.lit(""))
    distinct = documents.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path_a, path_b)
        for batch in byte_slices(batches, "text"):
            (n_a, n_b, n_groups), groups, pair, text, times = store.aligned(batch.column("text"))
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [
                *(batch.column(c) for c in ("key", "copies")),
                *(pa.array(n) for n in (n_a, n_b, n_groups, n_groups)),
                pa.array(groups, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(pair)),
                pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
            ]
            names = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return distinct.select(text_key(F.col("text")).alias("key"), "copies", "text").mapInArrow(align, ALIGNED_TYPE)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of every entry of the batch's lists."""
    pairs, times = batch.column("pairs"), batch.column("times")
    row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))
    return row, pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, b and n: how many links of the whole corpus hold the pair."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times = _lists(batch)
            found, place = np.unique(pair, return_inverse=True)
            n = np.bincount(place, times * batch.column("copies").to_numpy()[row], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

    partial = aligned.select("copies", "pairs", "times").mapInArrow(count, "pair bigint, n bigint")
    return partial.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", (F.col("pair") % (1 << 32)).alias("b"), "n")


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The pairs above a count that leaves at most ``most`` of them, and that count."""
    total = counts.count()
    least = 0
    while total > most:
        share = 1 - most / total
        found = counts.where(F.col("n") > least).agg(F.percentile_approx("n", share, 10_000)).first()[0]
        least = max(least + 1, found)
        total = counts.where(F.col("n") > least).count()
    return counts.where(F.col("n") > least), least


def measured(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` without its lists, with n_best and count_sum. It is read several times, so hand in a stored table."""
    counts = materialize(pair_counts(aligned), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    frequent, least = _frequent(counts, most_pairs)
    # One row per id of B at most, and at most most_pairs rows.
    rows = frequent.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")).toArrow()
    order = np.argsort(rows.column("pair").to_numpy(), kind="stable")
    table = tuple(np.asarray(rows.column(c).to_numpy())[order] for c in ("pair", "n", "best"))
    sent = aligned.sparkSession.sparkContext.broadcast(table)
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    plain = aligned.select(*names, "pairs", "times")
    schema = aligned.select(*names).schema.add("n_best", "long").add("count_sum", "long")

    def looked_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = sent.value[0]
        if not len(known):
            return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        place = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        return place, known[place] == pair

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for batch in batches:
            row, pair, times = _lists(batch)
            place, known = looked_up(pair)
            row, place, times = row[known], place[known], times[known]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[place])
            np.add.at(sums[1], row, times * n[place])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *map(pa.array, sums)], names=[*names, "n_best", "count_sum"]
            )

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times = _lists(batch)
            unknown = ~looked_up(pair)[1]
            keys = batch.column("key").take(pa.array(row[unknown]))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(pair[unknown]), pa.array(times[unknown])], names=["key", "pair", "times"]
            )

    found = plain.mapInArrow(measure, schema)
    if least == 0:
        return found
    others = (
        aligned.select("key", "pairs", "times")
        .mapInArrow(rare, "key binary, pair bigint, times bigint")
        .join(counts.where(F.col("n") <= least), "pair")
        .join(highest, "b")
        .groupBy("key")
        .agg(
            F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("times") * F.col("n")).alias("_sum"),
        )
    )
    added = {
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }
    return found.join(others, "key", "left").withColumns(added).drop("_best", "_sum")


def of_documents(documents: DataFrame, measures: DataFrame) -> DataFrame:
    """A row per document: doc_id and the measures of its text."""
    keyed = documents.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"))
    return keyed.join(measures.drop("copies"), "key").drop("key")


def alignment_digest(documents: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    aligned = aligned_texts(documents, path_a, path_b)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    stored = materialize(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned-texts")
    return of_documents(documents, measured(stored, most_pairs)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
