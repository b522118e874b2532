"""Exact token counts at every prefix (operator 13), by dynamic programming over prefixes.

Byte pair encoding has a local rule: a row of tokens is the encoding of its text if and only if every two
neighbours are what the merges make of them. So each prefix of a word has exactly one last token that fits
behind the last token of a shorter prefix, and its count is the shorter prefix's count plus one. One pass over a
word gives the last token and the count of all its prefixes; a second column of the same pass gives the count
when the word ends there, as the last token of a word carries an end mark. Words do not touch each other, so a
text's counts are those of its words, added up.

``with_prefix_tokens`` stores the counts as an array beside each text: element k + 1 is the number of tokens of
its first k code points, exactly as the tokenizer would count them. The columns ``total_tokens``,
``tokens_of_prefix`` and ``longest_prefix`` answer questions of length and budget from the array alone. A count
may fall when a prefix grows, as a longer word can be a single token; ``longest_prefix`` takes the longest of all
prefixes within the budget.

Strings of special tokens in a text count as the tokenizer's default counts them, one token each. A null or empty
text has the one count 0. Repeated rows and identifiers are counted by themselves; other columns are kept, and
one named like the result is replaced. An empty table stays empty. Texts are taken in slices of two megabytes, a
longer text alone, with some fifty bytes of memory a character. No row crosses a shuffle, and equal words are
worked out once for each slice, or once for a worker while it remembers them.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.llm.common import byte_slices
from vintageline.llm.tokens import WordStore, byte_symbols, distinct_words, spread, utf8_bytes, word_tokenizer, worker_state

PREFIX_TOKENS = "prefix_tokens"
TOKEN_LIMIT = 2048
REMEMBERED_WORDS = 400_000

# White space beyond ASCII: it separates words like a blank.
_WIDE_SPACE = re.compile(r"[\x85\xa0  -     　]")
# How the tokenizer splits ASCII text in lower case.
_ASCII_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class Merges:
    """The merges of a byte pair vocabulary, and which tokens can be neighbours."""

    def __init__(self, path: str, suffix: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.rank: dict[tuple[str, str], int] = {}
        made: dict[str, tuple[int, str, str]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[left, right] = rank
            made.setdefault(left + right, (rank, left, right))
        self.made = made
        self.suffix = suffix
        # For every token that stood before another: whether the other fits.
        self.known: dict[str | None, dict[str, bool]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        # A tree of the tokens that are their own encoding, by their symbols: [children, inner token, final token].
        self.tree: list = [{}, None, None]
        self.longest = max(map(len, model["vocab"]))
        alone: dict[str, bool] = {}
        for token in sorted(model["vocab"], key=len):
            step = made.get(token)
            alone[token] = step is None or (
                alone.get(step[1], True) and alone.get(step[2], True) and self._apart(step[1], step[2], step[0])
            )
            symbols, kind = (token[: -len(suffix)], 2) if token.endswith(suffix) else (token, 1)
            if alone[token] and symbols and (step is not None or len(symbols) == 1):
                node = self.tree
                for symbol in symbols:
                    node = node[0].setdefault(symbol, [{}, None, None])
                node[kind] = token

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """Symbols that stand at the right (0) or left (1) edge of a token while it is made, each with the rank of
        the merge that uses it up."""
        found = self.edges[side].get(token)
        if found is None:
            found, at, used = [], token, math.inf
            while True:
                found.append((at, used))
                if at not in self.made:
                    break
                used, left, right = self.made[at]
                at = left if side else right
            self.edges[side][token] = found
        return found

    def _apart(self, left: str, right: str, until: float = math.inf) -> bool:
        """Whether no merge crosses from ``left`` into ``right`` before rank ``until``. Of equal merges the first goes first."""
        heads, rank_of = self._edge(right, 1), self.rank.get
        for x, used in self._edge(left, 0):
            for y, y_used in heads:
                rank = rank_of((x, y))
                if rank is not None and rank < used and rank < until and rank <= y_used:
                    return False
        return True

    def _fits(self, before: str | None, token: str) -> bool:
        return before is None or self._apart(before, token)

    def counts(self, symbols: str) -> list[int]:
        """Tokens of the word that ends behind each symbol."""
        size = len(symbols)
        last: list[str | None] = [None] * (size + 1)
        inner, ended = [0] * (size + 1), [0] * (size + 1)
        known, tree = self.known, self.tree
        if len(known) > 100_000:
            known.clear()
        for start in range(size):
            before, count, node, end = last[start], inner[start] + 1, tree, start
            fits = known.get(before)
            if fits is None:
                fits = known[before] = {}
            for symbol in symbols[start : start + self.longest]:
                node = node[0].get(symbol)
                if node is None:
                    break
                end += 1
                token = node[1]
                if token is not None and not inner[end]:
                    fit = fits.get(token)
                    if fit is None:
                        fit = fits[token] = self._fits(before, token)
                    if fit:
                        last[end], inner[end] = token, count
                token = node[2]
                if token is not None and not ended[end]:
                    fit = fits.get(token)
                    if fit is None:
                        fit = fits[token] = self._fits(before, token)
                    if fit:
                        ended[end] = count
        return ended[1:]


class PrefixCounter:
    """Counts at all prefixes of texts; remembers words, up to a bound that only sets the speed."""

    def __init__(self, path: str, most_words: int = REMEMBERED_WORDS):
        self.tokenizer, suffix = word_tokenizer(path)
        self.merges = Merges(path, suffix)
        self.symbols = byte_symbols()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.runs: dict[str, list[int]] = {}
        self.most_runs = most_words // 2
        self.plain = WordStore(self._learner(self.piece), most_words, 12 * most_words)
        self.with_special = WordStore(self._learner(self.special_piece), most_words // 8, 2 * most_words)

    def _learner(self, count):
        def learn(words: list[str]) -> list[bytes]:
            if len(self.runs) > self.most_runs:
                self.runs = {}
            return [np.array(count(w), np.int32).tobytes() for w in words]

        return learn

    def run(self, run: str) -> list[int]:
        """Counts behind each character of one run of the tokenizer's splitting."""
        found = self.runs.get(run)
        if found is None:
            if run.isascii() and run.isprintable():
                found = self.merges.counts(run)
            else:
                data = run.encode()
                ends = self.merges.counts("".join(map(self.symbols.__getitem__, data)))
                found = [n for n, following in zip(ends, [*data[1:], 0]) if following & 0xC0 != 0x80]
            if run in _CONTRACTIONS:
                # Cut short, the letter behind the apostrophe is a run of its own.
                mark = self.run("'")[0]
                found = [mark, *(mark + n for n in self.run(run[1:])[:-1]), found[-1]]
            self.runs[run] = found
        return found

    def split(self, text: str) -> list[str]:
        """The runs of a normalised text without white space."""
        if text.isascii():
            return _ASCII_RUNS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _added(self, runs: Iterable[str]) -> list[int]:
        total, counts = 0, []
        for run in runs:
            found = self.run(run)
            counts += [total + n for n in found]
            total += found[-1]
        return counts

    def piece(self, word: str) -> list[int]:
        """Counts behind each character of text without ASCII white space and without special tokens."""
        if word.isascii():
            word = word.lower()
            return self.run(word) if word.isalpha() else self._added(self.split(word))
        total, counts = 0, []
        for part in _WIDE_SPACE.split(word):
            counts += [total + n for n in self._part(part)] + [0]
            total = total if not part else counts[-2]
            counts[-1] = total
        return counts[:-1]

    def _part(self, part: str) -> list[int]:
        if not part:
            return []
        normal = self.tokenizer.normalizer.normalize_str(part)
        if len(normal) == len(part) and unicodedata.is_normalized("NFC", part):
            return self._added(self.split(normal))
        return self._unsettled(part)

    def _unsettled(self, part: str) -> list[int]:
        """A part whose characters change their number when normalised: each prefix is normalised by itself from the
        last character that nothing before it can change, and counted anew from the run before that one."""
        normalize = self.tokenizer.normalizer.normalize_str
        counts, base, tail, start = [], 0, "", 0
        for k, character in enumerate(part):
            if k and _settled(character):
                tail, start = tail + normalize(part[start:k]), k
                runs = self.split(tail)
                if len(runs) > 3:
                    # What follows can only change the last two runs.
                    base += sum(self.run(r)[-1] for r in runs[:-2])
                    tail = "".join(runs[-2:])
            runs = self.split(tail + normalize(part[start : k + 1]))
            counts.append(base + sum(self.run(r)[-1] for r in runs))
        return counts

    def special_piece(self, word: str) -> list[int]:
        """Like ``piece``, for text as it was before lowering, in which strings of special tokens count once."""
        total, counts, before = 0, [], ""
        for k, part in enumerate(self.special_split.split(word)):
            if k % 2:
                # Until the string is complete, its beginning is ordinary text behind the part before.
                started = self.piece(before + part[:-1])[len(before) :]
                counts += [total + n for n in started]
                total += (self.piece(before)[-1] if before else 0) + 1
                counts.append(total)
            else:
                before = part
                counts += [total + n for n in self.piece(part)] if part else []
        return counts

    def arrays(self, texts: pa.Array) -> pa.ListArray:
        """The counts at all prefixes of each text, the empty prefix included."""
        texts = pc.fill_null(texts, "")
        if self.special_split is not None:
            odd = pc.match_substring(texts, self.special[0])
            for content in self.special[1:]:
                odd = pc.or_(odd, pc.match_substring(texts, content))
            where = odd.to_numpy(zero_copy_only=False)
            if where.any():
                plain = self._arrays(texts.filter(pc.invert(odd)), self.plain, True)
                special = self._arrays(texts.filter(odd), self.with_special, False)
                order = np.empty(len(where), np.int64)
                order[np.concatenate([np.nonzero(~where)[0], np.nonzero(where)[0]])] = np.arange(len(where))
                return pa.concat_arrays([plain, special]).take(pa.array(order))
        return self._arrays(texts, self.plain, True)

    def _arrays(self, texts: pa.Array, store: WordStore, lower: bool) -> pa.ListArray:
        words, at, per_text = distinct_words(pc.ascii_lower(texts) if lower else texts)
        places = store.places(words)[at]
        sizes = store.ends[places + 1] - store.ends[places]
        totals = np.where(sizes > 0, store.values[store.ends[places + 1] - 1], 0)
        data, bounds = utf8_bytes(texts)
        head = (data & 0xC0) != 0x80
        blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        before = np.ones(len(data), bool)
        before[1:] = blank[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.nonzero(~blank & before)[0]
        seen = np.concatenate([[0], np.cumsum(head)])
        characters = np.diff(seen[bounds])
        entries = np.concatenate([[0], np.cumsum(characters + 1)])
        text = np.repeat(np.arange(len(per_text)), per_text)
        ahead = np.cumsum(totals) - totals
        first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        per_text_ahead = np.concatenate([ahead, [totals.sum()]])[first] if len(first) else first
        ahead = ahead - per_text_ahead[text]
        # Behind a word and its white space the count stands still; inside it follows the word's own counts.
        begin = seen[starts] - seen[bounds[:-1]][text] + entries[:-1][text]
        level = np.zeros(entries[-1] + 1, np.int64)
        np.add.at(level, begin + sizes, totals)
        text_totals = np.bincount(text, totals, len(per_text)).astype(np.int64)
        np.subtract.at(level, entries[1:], text_totals)
        counts = np.cumsum(level[:-1])
        counts[spread(begin + 1, sizes)] = np.repeat(ahead, sizes) + store.values[spread(store.ends[places], sizes)]
        return pa.ListArray.from_arrays(pa.array(entries.astype(np.int32)), pa.array(counts.astype(np.int32)))


def _settled(character: str) -> bool:
    """Whether normalisation never joins the character to what stands before it."""
    if character.isascii():
        return True
    return unicodedata.combining(character) == 0 and character not in _seconds()


def _seconds() -> frozenset[str]:
    """Characters that canonical composition can join to the one before."""
    found = worker_state("composition")
    if "seconds" not in found:
        pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
        joined = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
        found["seconds"] = frozenset(joined | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))
    return found["seconds"]


def worker_counter(path: str) -> PrefixCounter:
    kept = worker_state("prefix_counters")
    if path not in kept:
        kept[path] = PrefixCounter(path)
    return kept[path]


def with_prefix_tokens(documents: DataFrame, tokenizer: str, name: str = PREFIX_TOKENS) -> DataFrame:
    """All columns of ``documents`` and, under ``name``, the counts at all prefixes of column text."""
    word_tokenizer(tokenizer)
    rows = documents.drop(name)
    columns = rows.columns
    at = columns.index("text")
    numbered = rows.toDF(*(f"c{i}" for i in range(len(columns))))
    schema = T.StructType([*numbered.schema.fields, T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in byte_slices(batches, f"c{at}"):
            found = counter.arrays(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.fieldNames())

    return numbered.mapInArrow(count, schema).toDF(*columns, name)


def total_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(prefix_tokens, -1).cast("long")


def tokens_of_prefix(prefix_tokens: Column, characters: Column) -> Column:
    """Tokens of the first ``characters`` code points; of the whole text where it has fewer."""
    return F.element_at(prefix_tokens, F.least(characters, F.size(prefix_tokens) - 1).cast("int") + 1).cast("long")


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """The most code points from the start of the text whose encoding has at most ``budget`` tokens."""
    within = F.transform(prefix_tokens, lambda n: n <= budget)
    found = F.size(prefix_tokens) - F.array_position(F.reverse(within), True)
    return F.when(total_tokens(prefix_tokens) <= budget, F.size(prefix_tokens) - 1).otherwise(found).cast("long")


def token_count_digest(documents: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of each text, whether it is over the limit, and the characters that fit."""
    counted = with_prefix_tokens(documents.select("doc_id", "text"), tokenizer)
    counts = F.col(PREFIX_TOKENS)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        total_tokens(counts).alias("n_tokens"),
        (total_tokens(counts) > limit).alias("over_limit"),
        longest_prefix(counts, limit).alias("fitting_chars"),
    )
