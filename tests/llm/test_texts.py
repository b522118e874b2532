"""Operators on texts against plain restatements of their rules, on odd cases and on a whole small table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vintageline.llm import language, mixing, packing, pii, repeats, scoring, simhash, token_files
from vintageline.llm.queries import PIECES, TOKENIZER
from vintageline.llm.tokens import WordEncoder

from .cases import no_documents, odd_documents

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "small"])
def documents(request, spark, small):
    return odd_documents(spark) if request.param == "odd" else small


# -- SimHash


def plain_fingerprint(text):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(documents):
    rows = rows_of(documents)
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    first = collections.defaultdict(list)
    for (doc_id, _), g in zip(rows, group):
        first[g].append(doc_id)
    expected = collections.Counter(
        (d, f"{p:016x}", min((x for x in first[g] if x is not None), default=None))
        for (d, _), p, g in zip(rows, prints, group)
    )
    assert collections.Counter(map(tuple, simhash.simhash_digest(documents).collect())) == expected


def test_forest_connects_what_all_links_connect():
    rng = random.Random(5)
    left, right = (np.array([rng.getrandbits(12) for _ in range(60)], np.uint64) for _ in range(2))
    a, b = simhash.forest(left, right, 2, rows=7)
    parent = {int(x): int(x) for x in np.concatenate([left, right])}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in left.tolist():
        for y in right.tolist():
            if (x ^ y).bit_count() <= 2:
                parent[max(root(x), root(y))] = min(root(x), root(y))
    found = dict(zip(a.tolist(), b.tolist()))
    assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}


def test_one_row_of_each_group_stays(spark):
    frame = odd_documents(spark)
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    groups = simhash.near_duplicates(frame).select("component").distinct().count()
    assert kept.count() == groups
    assert kept.where("doc_id = 3").count() == 1


# -- language identification


def test_languages_are_told_apart(small):
    lang = {r.doc_id: r.lang for r in small.collect()}
    found = language.language_digest(small, PIECES).collect()
    assert len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held_out = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert sum(held_out) >= 0.95 * len(held_out)


def test_language_of_odd_texts(spark):
    frame = odd_documents(spark)
    found = language.language_digest(frame, PIECES).collect()
    assert len(found) == frame.count()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (100, 101, 102, 103))
    assert by_id[106].lang_pred in ("de", "en")
    assert by_id[1].lang_pred == "en" and by_id[6].lang_pred == "de"


def test_pass_through_columns_keep_their_names(spark):
    frame = odd_documents(spark)
    model = language.learn(frame, PIECES)
    assert language.identified(frame, model).columns == [*frame.columns, "lang_pred", "_score"]
    assert pii.pii_spans(frame).columns == [*frame.columns, "_spans", "redacted"]


def test_nothing_to_learn_from(spark):
    frame = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_digest(frame, PIECES).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    tree = language.PieceTree(["▁", "▁a", "a", "b", "ab", "▁ab"])
    chance = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.15], [0.1]])
    lattice = language.Lattice(["ab", "ax"], tree)
    total = lattice.total(lattice.forward(chance))[:, 0]
    assert total[0] == pytest.approx(0.1 * 0.15 * 0.25 + 0.1 * 0.05 + 0.2 * 0.25 + 0.15)
    assert total[1] == pytest.approx(0.1 * 0.15 * 0.1 + 0.2 * 0.1)
    uses = lattice.expected(chance, np.array([[2.0], [0.0]]))[:, 0]
    assert uses[5] == pytest.approx(2 * 0.15 / total[0])
    assert uses[3] == pytest.approx(2 * (0.1 * 0.15 * 0.25 + 0.2 * 0.25) / total[0])


# -- mixing


def test_mix_reaches_targets(documents):
    rows = documents.select("source", "text").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (left - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in order}
    mixed = mixing.mixed(documents).collect()
    assert len(mixed) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 * max(largest.values()) for s in order)


def test_mix_spreads_rows_without_doc_id(spark):
    rows = [(None, f"w{i} x", "a", None) for i in range(300)] + [(7, f"v{i}", "b", None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    once = mixing.mixed(frame).collect()
    taken = collections.Counter()
    for r in once:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    targets = {r.source: r.target for r in once}
    assert len(once) == 600 and all(abs(taken[s] - targets[s]) <= 2 for s in targets)


def test_language_sample_splits_a_common_text(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(3000)] + [(9000 + i, f"the dog {i} and the cat", "en") for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(labelled, PIECES, sample=100, rounds=2)
    got = [r.lang_pred for r in language.identified(labelled.limit(1).unionByName(labelled.where("doc_id = 9001")), model).collect()]
    assert got == ["de", "en"]


def test_mix_reruns_agree_and_copies_follow(spark):
    frame = odd_documents(spark)
    once, again = (sorted(map(str, mixing.mix_digest(frame).collect())) for _ in range(2))
    assert once == again
    copies = mixing.mixed_documents(frame)
    assert copies.columns == frame.columns
    assert copies.agg(F.sum(mixing.word_count())).first()[0] == mixing.mixed(frame).agg(F.sum("taken")).first()[0]


# -- tokens


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(TOKENIZER)
    found.encode_special_tokens = True
    return found


ODD_TEXTS = [
    "İstanbul ΣΑΣ Ὀδυσσεύς naïve don't WE'LL it's, x...y (a).b; \x1c z\x85w \xa0q 123,456 <|endoftext|>",
    "ﬁ Å ½ don't. l'été' a's,   end", "", "ẞß ÇA'M 's a'. it's. can't, we're!! '", "中文 字符, 한국어. é. é á éx.",
    "<|startoftext|>foo bar<|endoftext|>", "...", "\t\n", None,
]


def test_word_encoder_equals_the_tokenizer(tokenizer, small):
    texts = ODD_TEXTS + [t for _, t in rows_of(small)][:60]
    encoder = WordEncoder(TOKENIZER, most_words=200)
    for texts_together in (texts, texts[::-1]):
        ids, ends = encoder.encode(texts_together)
        starts = [0, *ends[:-1].tolist()]
        for text, a, b in zip(texts_together, starts, ends.tolist()):
            assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def with_end(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(documents, tokenizer, folder, spark):
    rows = sorted(rows_of(documents), key=lambda r: (r[0] is not None, r[0] or 0))
    found = token_files.token_file_digest(documents, TOKENIZER).collect()
    expected, at = collections.Counter(), 0
    starts = {}
    for doc_id, text in rows:
        ids = with_end(tokenizer, text, 1)
        starts.setdefault(doc_id, at)
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    first = {}
    for r in found:
        first[r.doc_id] = min(r.start, first.get(r.doc_id, r.start))
    assert first == starts
    spans = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])]


def test_token_files_are_pruned_by_id(small, tokenizer, folder, spark):
    path = f"{folder}/tokens"
    token_files.write_token_files(small, path, TOKENIZER)
    wanted = token_files.read_token_files(spark, path).where("doc_id = 17").collect()
    text = small.where("doc_id = 17").first().text
    assert [list(r.ids) for r in wanted] == [with_end(tokenizer, text, 1).tolist()]


def test_packing_loses_no_id(documents, tokenizer):
    rows = rows_of(documents)
    pieces = packing.packing_digest(documents, TOKENIZER).collect()
    streams = collections.Counter(with_end(tokenizer, t, 2).tobytes() for _, t in rows)
    ids = packing.packed(documents, TOKENIZER).collect()
    assert sorted(zlib.crc32(r.ids) for r in ids) == sorted(r.ids_crc32 for r in pieces)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE_TOKENS
    assert sum(r.length for r in pieces) == sum(len(s) // 4 * n for s, n in streams.items())
    # All but the last sequence of the one group are full.
    used = sorted(sum(r.length for r in held) for held in sequences.values())
    assert sum(packing.SEQUENCE_TOKENS - n for n in used) < packing.SEQUENCE_TOKENS


@pytest.mark.parametrize("seed", range(6))
def test_placing_covers_every_document(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 3, 64, 65, 200, rng.randrange(1, 100)]) for _ in range(rng.randrange(40))]
    placed = packing.place_pieces(lengths, 64)
    covered = collections.defaultdict(list)
    rooms = collections.defaultdict(list)
    for document, start, length, sequence, offset in placed:
        covered[document].append((start, start + length))
        rooms[sequence].append((offset, offset + length))
    for document, length in enumerate(lengths):
        spans = sorted(covered[document])
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)]
        assert (spans[-1][1] if spans else 0) == length
    for spans in rooms.values():
        assert [a for a, _ in sorted(spans)] == [0, *(b for _, b in sorted(spans))][: len(spans)]
        assert max(b for _, b in spans) <= 64
    assert len(rooms) == -(-sum(lengths) // 64)


# -- language-model scores


def test_base_scores_and_better_model(documents):
    rows = rows_of(documents)
    texts = [[*WORDS.findall(lower(t)), None] for _, t in rows]
    trains = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    seen = collections.Counter(w for ws, t in zip(texts, trains) if t for w in ws)
    tokens, kinds = sum(seen.values()), len(seen)
    scale = math.log10(tokens + 0.1 * (kinds + 1))
    expected = collections.Counter()
    for (d, _), ws, t in zip(rows, texts, trains):
        base = sum(math.log10(seen[w] + 0.1) - scale for w in ws)
        expected[d, not t, len(ws), sum(seen[w] > 0 for w in ws), tokens, round(base, 4)] += 1
    found = scoring.scored(documents).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found]
    assert collections.Counter(got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


class PlainBackoff:
    """The model restated: probability of a word after a list of words, by the definition."""

    def __init__(self, texts):
        self.grams = [collections.Counter(g for ws in texts for g in zip(*(ws[k:] for k in range(n)))) for n in (1, 2, 3)]
        self.tokens, self.kinds = sum(self.grams[0].values()), len(self.grams[0])
        self.after = collections.defaultdict(list)
        for order in (1, 2):
            for gram, n in self.grams[order].items():
                if n >= 2:
                    self.after[gram[:-1]].append((gram[-1], n))

    def chance(self, context, word):
        context = tuple(context[-2:])
        if not context:
            return (self.grams[0][word,] + 0.1) / (self.tokens + 0.1 * (self.kinds + 1))
        seen = self.after.get(context, [])
        count = self.grams[len(context) - 1][context]
        for other, n in seen:
            if other == word:
                return (n - 0.5) / count
        left = 1 - sum((n - 0.5) / count for _, n in seen)
        spread = 1 - sum(self.chance(context[1:], other) for other, _ in seen)
        return left / spread * self.chance(context[1:], word)

    def score(self, words):
        return sum(math.log10(self.chance(words[:k], w)) for k, w in enumerate(words))


def test_backoff_model_is_a_distribution():
    rng = random.Random(2)
    model = PlainBackoff([[*(rng.choice("abcd") for _ in range(rng.randrange(9))), None] for _ in range(60)])
    for history in ([], *map(list, ("a", "b", "ab", "bc", "dda", "cab")), ["unseen"], ["unseen", "a"]):
        words = [*"abcd", None, "unseen"]
        assert sum(model.chance(history, w) for w in words) == pytest.approx(1.0)


def test_every_repeated_gram_is_kept(spark):
    # A phrase of rare words twice among many other words: far under any share of the tokens, seen in two blocks.
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(300)))) for k in range(400)]
    rows += [(k, f"once{k} quartz violet lantern zephyr twice{k}") for k in (1001, 1002, 1003)] + [(None, ""), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [[*WORDS.findall(lower(t)), None] for _, t in rows]
    trains = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    model = PlainBackoff([ws for ws, t in zip(texts, trains) if t])
    expected = sorted((d or -1, round(model.score(ws), 6)) for (d, _), ws in zip(rows, texts))
    for limits in ({}, {"block_tokens": 500, "shard_tokens": 3000}):
        got = sorted((r.doc_id or -1, round(r.score, 6)) for r in scoring.scored(frame, **limits).collect())
        assert [d for d, _ in got] == [d for d, _ in expected]
        assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    # Whole texts side by side, and in parts of three words, give the same scores.
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(size))) for k, size in enumerate((900, 7, 3, 0, 1, 64) * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = PlainBackoff([[*t.split(), None] for d, t in rows if zlib.crc32(str(d).encode()) % 10])
    expected = [model.score([*t.split(), None]) for _, t in rows]
    got = [r.score for r in scoring.scored(frame).orderBy("doc_id").collect()]
    assert got == pytest.approx(expected, abs=1e-6)
    monkeypatch.setattr(scoring, "LANE", 3)
    assert [r.score for r in scoring.scored(frame).orderBy("doc_id").collect()] == pytest.approx(got, abs=1e-9)


# -- repeated passages


def plain_repeats(rows, width=100):
    seen, found = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        covered = [False] * len(data)
        for i in range(len(data) - width + 1):
            string = data[i : i + width]
            if string in seen:
                covered[i : i + width] = [True] * width
            seen.add(string)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and not p for c, p in zip(covered, [False, *covered]))
        found.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(found)


def test_repeats_match_all_strings(documents):
    found = collections.Counter(map(tuple, repeats.repeats_digest(documents).collect()))
    assert found == plain_repeats(rows_of(documents))


def test_repeats_of_crowded_anchors(spark, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60))
    ends = ["".join(rng.choice("ijklmnop ") for _ in range(45)) for _ in range(6)]
    rows = [(k, ends[k % 6] + line + ends[(k * k + 1) % 6] + str(k)) for k in range(40)]
    monkeypatch.setattr(repeats, "GROUP", 3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, repeats.repeats_digest(frame).collect())) == plain_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_longest_previous_factors(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randrange(1, 60))]

    def shared(a, b):
        return next((k for k in range(6) if a[k] != b[k]), 6)

    expected = [max((shared(s, e) for e in strings[:k]), default=0) for k, s in enumerate(strings)]
    assert repeats.longest_previous_factors(strings).tolist() == expected


def test_pieces_of_long_texts_meet(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abc ") for _ in range(3000))
    whole = [np.concatenate(x) for x in zip(*repeats.segments_of(text))]
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = [np.concatenate(x) for x in zip(*repeats.segments_of(text))]
    for _, starts, ends in (whole, parts):
        covered = [p for a, b in zip(starts, ends) for p in range(a, b - repeats.WIDTH + 1)]
        assert covered == list(range(len(text) - repeats.WIDTH + 1))


# -- personal data


def plain_spans(text):
    """The four base rules by their patterns alone."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


SEEDS = ["a.b@c.de", "@", "x@y", "a@b@c.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
         "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "..@a.b", " ", "\n", "é", "0012.01.1.9", "+123456789012345678",
         "DE89 3704 0044 0532 0130 00", "078-05-1120", "-"]


@pytest.mark.parametrize("seed", range(30))
def test_base_spans_are_the_patterns(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(SEEDS + ["7", "4", "@", ".", "+"]) for _ in range(25))
    base = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
    assert base == plain_spans(text)


def test_pii_digest(documents):
    expected = collections.Counter()
    for doc_id, text in rows_of(documents):
        spans = plain_spans(text or "")
        joined = ",".join(":".join(map(str, s)) for s in spans)
        counts = collections.Counter(s[0] for s in spans)
        expected[(doc_id, *(counts[k] for k in pii.BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest())] += 1
    found = pii.pii_digest(documents).collect()
    assert collections.Counter(tuple(r)[:6] for r in found) == expected


def test_checksums_and_context():
    text = "My bank account is DE89 3704 0044 0532 0130 00, and DE89 3704 0044 0532 0130 01 is wrong."
    assert [s[0] for s in pii.find_spans(text)] == ["iban"]
    assert [s[0] for s in pii.find_spans("social security 078-05-1120")] == ["ssn"]
    assert pii.find_spans("page 078-05-1120") == []
    assert pii.redacted("to a@b.cd now", pii.find_spans("to a@b.cd now")) == "to <EMAIL> now"


# -- the pipeline


def test_pipeline_stages_take_effect(spark):
    frame = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars", "copies")
    tail = spark.createDataFrame([(200, "mail me at some.one@example.org please and thank you all", "en", "s1", 5, 0)], frame.schema)
    docs = frame.union(tail)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == frame.columns
        seen[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    assert not {100, 101, 102, 103} & set(ids["language"]) and set(range(24)) <= set(ids["language"])
    assert all(r.lang is not None for r in seen["language"])
    assert ids["near_duplicates"].count(3) == 1
    clean = {r.doc_id: r for r in seen["personal_data"]}
    assert clean[200].text == "mail me at <EMAIL> please and thank you all" and clean[200].n_chars == len(clean[200].text)
    assert set(ids["mix"]) <= set(ids["personal_data"]) and max(collections.Counter(ids["mix"]).values()) <= 2
    pieces = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id is None) >= 0
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_pipeline_runs_on_a_table(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert pieces.where(F.octet_length("ids") != 4 * F.col("length")).isEmpty() and not pieces.isEmpty()


# -- empty tables


@pytest.mark.parametrize(
    "operator",
    [
        simhash.simhash_digest,
        lambda d: language.language_digest(d, PIECES),
        mixing.mix_digest,
        mixing.mixed_documents,
        lambda d: packing.packing_digest(d, TOKENIZER),
        scoring.scored,
        repeats.repeats_digest,
        pii.pii_digest,
        lambda d: token_files.token_file_digest(d, TOKENIZER),
        simhash.first_of_each,
    ],
)
def test_empty_table_gives_empty_result(spark, operator):
    assert operator(no_documents(spark)).collect() == []


def test_rows_that_differ_in_where_a_null_stands_are_kept_apart(spark):
    """One doc_id, four rows: a text with its source or its language missing, no text, and the text 'en'."""
    words = " ".join(f"word{k}" for k in range(30))
    rows = [(7, words, "web", None), (7, words, None, "web"), (8, None, "en", None), (8, "en", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {tuple(r) for r in simhash.first_of_each(frame).collect()}
    assert len(kept) == 3 and set(rows[2:]) <= kept and kept <= set(rows)
    twins = spark.createDataFrame(
        [(7, words, "web", None), (7, words, None, "web")], "doc_id long, text string, lang string, source string"
    )
    taken = sum(r.copies for r in mixing.mixed(twins).collect())
    mixed = [tuple(r) for r in mixing.mixed_documents(twins).collect()]
    assert len(mixed) == taken and set(mixed) <= set(rows[:2])


def test_adjacent_ibans_are_both_found():
    spans = pii.find_spans("iban NO9386011117947 NO9386011117947")
    assert [s[:3] for s in spans if s[0] == "iban"] == [("iban", 5, 20), ("iban", 21, 36)]
