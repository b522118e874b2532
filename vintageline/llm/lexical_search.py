"""Ranked lexical search (operator 11) by scanning documents with an automaton of all item terms.

No index of the documents is built. The distinct terms of the items become the patterns of an Aho-Corasick
automaton, each between two blanks, so that a term is found only where it stands alone; a text is brought to the same
form by turning every byte that is no part of a term into a blank. One pass over a text then gives the number of its
terms and how often it holds each item term. Document frequencies are counted from these findings, the automaton's
outputs are mapped to the items that hold the term, and every task keeps the best ``top`` documents per item, so
only those meet in the final ranking.

The automaton is broadcast. Its size is checked: items are dealt into parts of some ``most_terms`` terms, and each
part is a pass over the documents with an automaton of its own. An item lies wholly in one part.

Null and empty texts have no term: such documents count nowhere and such items have no row. Rows of one item_id are
one item, a null item_id is an item too. Repeated documents and doc_ids are documents of their own; among equal
scores the smaller doc_id comes first, null before all. Empty tables give no row. Other columns are not used.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vintageline.llm.common import byte_slices, materialize
from vintageline.llm.tokens import spread, utf8_bytes, worker_state

TOP = 50
# Terms of one automaton: with some 100 bytes of memory a letter, about 150 MB for terms of 15 letters.
MOST_TERMS = 100_000
# Terms that a larger share of the items hold are added up by a matrix product.
COMMON_SHARE = 1 / 16
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """All terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM_PATTERN})"), F.lit(1))


def term_bytes() -> np.ndarray:
    """Per byte: itself in lower case if it belongs to a term, else a blank."""
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for first, last, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0)):
        table[first : last + 1] = np.arange(first, last + 1) + shift
    return table


def guarded_automaton(terms: list[str]):
    """An automaton that finds ``terms`` between blanks and gives their places in the list."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        automaton.add_word(f" {term} ", place)
    automaton.make_automaton()
    return automaton


def findings(texts: pa.Array, automaton, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; and, for every (text, item term) found: text, term and how often."""
    data, bounds = utf8_bytes(texts)
    plain = term_bytes()[data]
    begins = plain != 0x20
    begins[1:] &= plain[:-1] == 0x20
    begins[bounds[:-1][bounds[:-1] < len(data)]] = (plain != 0x20)[bounds[:-1][bounds[:-1] < len(data)]]
    sums = np.concatenate([[0], np.cumsum(begins)])
    n = np.diff(sums[bounds])
    found, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hits = [place for _, place in automaton.iter(f" {plain[a:b].tobytes().decode()} ")]
        found += hits
        sizes.append(len(hits))
    keys = np.repeat(np.arange(len(sizes)), sizes) * count + np.array(found, np.int64)
    pairs, times = np.unique(keys, return_counts=True)
    return n, pairs // count, pairs % count, times


class BestOfEach:
    """The ``top`` best (score, smaller doc_id) of each item among all that was offered."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item; nothing under an item's least can enter."""
        row, item = np.nonzero(scores >= self.least)
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[row, item]])
        self.doc = np.concatenate([self.doc, doc[row]])
        self.null = np.concatenate([self.null, null[row]])
        if len(self.item) > 4 * self.top * len(self.least) + 1000:
            self.reduce()

    def reduce(self) -> None:
        order = np.lexsort((self.doc, ~self.null, -self.score, self.item))
        item = self.item[order]
        first = np.searchsorted(item, item, "left")
        rank = np.arange(len(item)) - first
        kept = order[rank < self.top]
        last = np.nonzero(rank == self.top - 1)[0]
        self.least[item[last]] = self.score[order][last]
        self.item, self.score, self.doc, self.null = (
            x[kept] for x in (self.item, self.score, self.doc, self.null)
        )


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class ItemScorer:
    """Adds up term scores per item; all sums are integers below 2**53, so doubles hold them exactly."""

    def __init__(self, items_of_term: list[list[int]], weights: np.ndarray, items: int, documents: int, total: int):
        self.weights, self.items, self.documents, self.total = weights, items, documents, total
        sizes = np.array([len(i) for i in items_of_term], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.array([i for held in items_of_term for i in held], np.int64)
        common = np.nonzero(sizes > max(8, items * COMMON_SHARE))[0]
        self.column = np.full(len(sizes), -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.held = np.zeros((len(common), items))
        for k, term in enumerate(common.tolist()):
            self.held[k, items_of_term[term]] = 1

    def scores(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // max(self.total, 1)
        value = self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[row]))
        column = self.column[term]
        is_common = column >= 0
        dense = np.zeros((len(n), len(self.held)))
        dense[row[is_common], column[is_common]] = value[is_common]
        result = dense @ self.held
        rare = ~is_common
        starts, sizes = self.ends[term[rare]], self.ends[term[rare] + 1] - self.ends[term[rare]]
        where = np.repeat(row[rare], sizes) * self.items + self.flat[spread(starts, sizes)]
        added = np.bincount(where, np.repeat(value[rare], sizes).astype(float), len(n) * self.items)
        return (result + added.reshape(len(n), self.items)).astype(np.int64)


FOUND_TYPE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def _scanned(documents: DataFrame, terms: list[str]) -> DataFrame:
    """For each document: its number of terms, and which of ``terms`` it holds how often."""
    name, sent = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state("automaton")
        if name not in kept:
            kept.clear()
            kept[name] = guarded_automaton(sent.value)
        for batch in byte_slices(batches, "text"):
            n, row, term, times = findings(batch.column("text").fill_null(""), kept[name], len(sent.value))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, times)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *lists], names=FOUND_TYPE.fieldNames()
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FOUND_TYPE)


def _best(found: DataFrame, scorer: ItemScorer, ids: list, id_type: T.DataType, top: int) -> DataFrame:
    """Each task's best documents per item: item_id, doc_id, score."""
    result = best_type(id_type)
    arrow_id = to_arrow_type(id_type)
    sent = found.sparkSession.sparkContext.broadcast((scorer, ids))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, ids = sent.value
        rows = max(1, 2_000_000 // max(1, scorer.items))
        best = BestOfEach(scorer.items, top)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                terms, times = batch.column("terms"), batch.column("times")
                row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
                numbers = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, times)]
                doc = batch.column("doc_id")
                scores = scorer.scores(batch.column("n").to_numpy(zero_copy_only=False), row, *numbers)
                best.offer(scores, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        best.reduce()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in best.item.tolist()], arrow_id),
                pa.array(best.doc, mask=best.null),
                pa.array(best.score),
            ],
            names=result.fieldNames(),
        )

    return found.mapInArrow(score, result)


def best_type(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("item_id", id_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
    )


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    gathered = F.array_distinct(F.flatten(F.collect_list(terms_of(F.col("text")))))
    per_item = materialize(
        items.where(F.col("text").isNotNull()).groupBy("item_id").agg(gathered.alias("terms")).where(F.size("terms") > 0),
        "search-items",
    )
    held = per_item.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-held // most_terms))
    id_type = items.schema["item_id"].dataType
    best = None
    for part in range(parts):
        # At most about most_terms terms reach the driver at a time, whatever the number of items.
        mine = per_item.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        found = _ranked_part(documents, mine, id_type, top)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score"
    )


def _ranked_part(documents: DataFrame, items: list, id_type: T.DataType, top: int) -> DataFrame:
    places: dict[str, int] = {}
    items_of_term: list[list[int]] = []
    for number, item in enumerate(items):
        for term in item.terms:
            if term not in places:
                places[term] = len(places)
                items_of_term.append([])
            items_of_term[places[term]].append(number)
    if not places:
        return documents.sparkSession.createDataFrame([], best_type(id_type))
    found = materialize(_scanned(documents, list(places)), "search-found")
    documents_with, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.full(len(places), term_weight(documents_with, 0), np.int64)
    for row in holding:
        weights[row["term"]] = term_weight(documents_with, row["count"])
    scorer = ItemScorer(items_of_term, weights, len(items), documents_with, total)
    return _best(found, scorer, [i.item_id for i in items], id_type, top)


SEARCH_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {TOP}
"""
