"""Counts at every prefix beside the tokenizer's own encoding of every prefix."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import no_documents, odd_documents
from vintageline.llm.common import table
from vintageline.llm.prefix_counts import (
    PrefixCounter,
    longest_prefix,
    token_count_digest,
    tokens_of_prefix,
    total_tokens,
    with_prefix_tokens,
)
from vintageline.llm.queries import TOKENIZER

ODD = [
    "", None, "don't can't we're 're 'r e'll!'s '' 'tis", "a  b\t\nc ", "Ünïcödé ñandú 中文 éá ạ̈x",
    "<|endoftext|> a<|startoftext|>b <|endof <|ENDOFTEXT|> <|endoftext|><|endoftext|>don<|endoftext|>'t",
    "x" * 300, "İstanbul ΑΣ ΣΑΣ ǅ", "a\xa0b　　c\xa0 d", "1234 56a7 !!??..a", "ab\x1ccd \x00e\x7f", "한국어 한글",
    "tokenization internationalization aaaaaaaaaaaa ababab", "naïve’s “quote” — 😀😀👍🏽 👩‍👩‍👧", "é" * 60, "'" * 20 + "s",
    "é!é?é1é'sé're", "'ré 'ré",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(TOKENIZER, most_words=300)


def brute(tokenizer, text):
    text = text or ""
    prefixes = [text[:k] for k in range(len(text) + 1)]
    return [len(e.ids) for e in tokenizer.encode_batch(prefixes, add_special_tokens=False)]


def test_every_prefix_of_odd_texts(tokenizer, counter):
    for text, found in zip(ODD, counter.arrays(pa.array(ODD, pa.string())).to_pylist()):
        assert found == brute(tokenizer, text), text


def test_every_prefix_of_random_texts(tokenizer, counter):
    chance = random.Random(1)
    pools = ["ab", "abcdefghij", "the'srdmlv ", "aeiouhtns", "éèaàu ", "xyz!?.' 12", "한ㅏᅡᆨ가 "]
    texts = ["".join(chance.choices(chance.choice(pools), k=chance.randint(1, 60))) for _ in range(300)]
    for text, found in zip(texts, counter.arrays(pa.array(texts)).to_pylist()):
        assert found == brute(tokenizer, text), text


def test_a_long_run_is_counted_as_the_tokenizer_does(tokenizer, counter):
    text = "ab" * 20_000
    found = counter.arrays(pa.array([text])).to_pylist()[0]
    assert len(found) == len(text) + 1
    assert found[-1] == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="one by one"):
        PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_documents_keep_their_columns_and_rows(spark, tokenizer):
    rows = odd_documents(spark).withColumn("prefix_tokens", F.lit("old"))
    found = with_prefix_tokens(rows, TOKENIZER)
    assert found.columns == [*rows.drop("prefix_tokens").columns, "prefix_tokens"]
    kept = found.select("doc_id", "text", "fp", total_tokens(F.col("prefix_tokens")).alias("n")).collect()
    assert len(kept) == rows.count()
    for row in kept:
        assert row.fp == "z" and row.n == len(tokenizer.encode(row.text or "", add_special_tokens=False).ids)
    assert with_prefix_tokens(no_documents(spark), TOKENIZER).count() == 0


def test_questions_of_budget_need_no_encoding(spark, tokenizer):
    texts = [(k, t) for k, t in enumerate(t for t in ODD if t is not None)]
    counts = F.col("prefix_tokens")
    for budget in (0, 1, 2, 5, 1000):
        asked = with_prefix_tokens(spark.createDataFrame(texts, "id int, text string"), TOKENIZER).select(
            "text", longest_prefix(counts, budget).alias("fits"), tokens_of_prefix(counts, F.lit(3)).alias("three")
        )
        for row in asked.collect():
            every = brute(tokenizer, row.text)
            assert row.fits == max(k for k, n in enumerate(every) if n <= budget)
            assert row.three == every[min(3, len(row.text))]


def test_digest_of_a_whole_table(spark, tokenizer):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    found = {r.doc_id: r for r in token_count_digest(documents, TOKENIZER).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    for row in rows:
        n = len(tokenizer.encode(row.text or "", add_special_tokens=False).ids)
        got = found[row.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len((row.text or "").encode()), n, n > 2048)
        assert len(tokenizer.encode((row.text or "")[: got.fitting_chars], add_special_tokens=False).ids) <= 2048
