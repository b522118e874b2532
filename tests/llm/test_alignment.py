"""Alignment beside a plain restatement with both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import no_documents, odd_documents
from vintageline.llm.alignment import alignment_digest, aligned_texts
from vintageline.llm.common import table
from vintageline.llm.queries import BYTES, PIECES
from vintageline.llm.tokens import byte_symbols

NONE = (0, 0, 0, 0, 0, 0, "")


def plain_alignment(texts):
    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {s: b for b, s in byte_symbols().items()}
    named = {i: t for t, i in a_side.get_vocab().items()}
    found = []
    for text in texts:
        spelled = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        bytes_a = [bytes(byte_of[c] for c in named[i]) for i in a]
        pieces = [b_side.id_to_piece(i) for i in b]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)
        ]
        if not text or b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
            found.append(None)
            continue
        ends_a = {sum(map(len, bytes_a[: k + 1])): k for k in range(len(a))} if len(a) < 3000 else _ends(bytes_a)
        ends_b = {sum(map(len, bytes_b[: k + 1])): k for k in range(len(b))} if len(b) < 3000 else _ends(bytes_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        found.append((len(a), len(b), ";".join(groups), links))
    counts = Counter(link for f in found if f for link in f[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    result = []
    for f in found:
        if f is None:
            result.append(NONE)
            continue
        n_a, n_b, groups, links = f
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        result.append((n_a, n_b, len(links), len(links), best, sum(counts[link] for link in links), digest))
    return result


def _ends(spells):
    at, ends = 0, {}
    for k, s in enumerate(spells):
        at += len(s)
        ends[at] = k
    return ends


def compared(documents, most_pairs=500_000):
    rows = documents.select("doc_id", "text").collect()
    expected = Counter(zip((r.doc_id for r in rows), plain_alignment([r.text for r in rows])))
    found = alignment_digest(documents, BYTES, PIECES, most_pairs).collect()
    return Counter((r.doc_id, tuple(r)[1:]) for r in found), expected


@pytest.mark.parametrize("most_pairs", [500_000, 40])
def test_odd_texts(spark, most_pairs):
    found, expected = compared(odd_documents(spark), most_pairs)
    assert found == expected


def test_white_space_and_signs_of_all_kinds(spark):
    chance = random.Random(3)
    pool = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", " ", "à", "é", "▁", "<s>", "<0x41>", "<|endoftext|>", "'s", "12", "!?", "😀", "\x1c", "\x00", "x ", "ª"]
    texts = ["".join(chance.choices(pool, k=chance.randint(1, 12))) for _ in range(400)] + [" ", "  ", "a ", " a", "\n", "à la", "a\n  b", "a \n b "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, expected = compared(rows)
    assert found == expected


def test_a_whole_table(spark):
    found, expected = compared(table(spark, "/root/testdata/sf0.001", "documents"))
    assert found == expected


def test_each_distinct_text_has_one_row(spark):
    rows = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (4, "")], "doc_id long, text string")
    found = {r.copies: r for r in aligned_texts(rows, BYTES, PIECES).collect() if r.n_groups}
    assert list(found) == [2] and found[2].groups.count("|") == found[2].n_groups


def test_an_empty_table(spark):
    assert alignment_digest(no_documents(spark), BYTES, PIECES).count() == 0
