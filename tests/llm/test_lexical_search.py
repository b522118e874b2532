"""Ranked search beside a plain restatement of the score."""

import math
import re
from collections import Counter

import pytest

from tests.llm.cases import no_documents, odd_documents
from vintageline.llm.common import table
from vintageline.llm.lexical_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(documents, items, top=50):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    n_docs = sum(bool(t) for _, t in held)
    total = sum(sum(t.values()) for _, t in held)
    df = Counter(term for _, t in held for term in t)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    result = {}
    for item_id, words in wanted.items():
        scored = []
        for doc_id, t in held:
            n = sum(t.values())
            m = 50 + (50 * n * n_docs) // total if n else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 20 * m))
                for w in words
                if t[w]
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            result[item_id, rank] = (doc_id, -score)
    return result


def found(frame):
    rows = frame.collect()
    result = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(result) == len(rows)
    return result


ITEMS = [
    (1, "The HOUSE by the river"), (2, "haus, fluss; zhouse"), (3, "w1 w2 w3 w996"), (4, None), (5, ""), (6, "!!! ..."),
    (7, "Ünïcödé 中文"), (8, "x" * 50_000), (None, "storm"), (1, "town"), (9, "nowhere-to-be-found"),
]


@pytest.mark.parametrize("most_terms", [100_000, 4])
def test_ranking_of_odd_texts(spark, most_terms):
    documents = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(ranked(documents, items, top=5, most_terms=most_terms)) == plain_ranking(pairs, ITEMS, 5)


def test_ties_go_to_the_smaller_identifier(spark):
    rows = [(k, "same words here") for k in (9, 3, 7, 3)] + [(None, "same words here"), (1, "other"), (2, "same")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([("a", "SAME words")], "item_id string, text string")
    assert found(ranked(documents, items)) == plain_ranking(rows, [("a", "SAME words")])


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(no_documents(spark), items).count() == 0
    assert ranked(odd_documents(spark), items.limit(0)).count() == 0


def test_ranking_of_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    documents, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = [(r.item_id, r.text) for r in items.collect()]
    assert found(ranked(documents, items)) == plain_ranking(pairs, wanted)
