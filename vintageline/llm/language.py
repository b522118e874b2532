"""Language identification (operator 4) by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Every language has a probability for each piece, and a
word's probability in a language is the sum over all ways to cut it into pieces, each the product of its
pieces' probabilities; the forward algorithm sums them left to right. A text's score is the product over its
words, and the prediction the language with the highest, its share among all languages being the score.

Learning is expectation maximisation on words: the expected number of times each piece is used, over all
cuts of all words of a language, becomes its new probability. It reads a sample of about
``SAMPLE_DOCUMENTS`` training documents per language, chosen by a hash of the text; this bound is a
parameter. Counts of the sample are made by Spark jobs and only sums per language and piece, at most the
vocabulary for each, reach the driver. Predictions read every whole text where it lies, without a shuffle.

A word is a run of letters, lower-cased, scored in segments of at most 40 letters behind one word mark. A
null text and a text without a letter get ``und`` and score 0; so does every text if nothing was there to
learn from. Ties go to the language first by code point. Rows are independent, so repeated rows and null
identifiers need no rule. A null lang is not learned from. Other columns pass through; result columns whose
names the frame already has get leading underscores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.llm.common import free_name, is_training, materialize, slices
from vintageline.llm.tokens import Places

UNDETERMINED = "und"
SAMPLE_DOCUMENTS = 400
ROUNDS = 3
SEGMENT = 40
SMOOTHING = 0.1
MARK = "▁"

_LETTER_RUN = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters, cut into segments."""
    words = _LETTER_RUN.findall(text.lower()) if text else []
    if all(len(w) <= SEGMENT and w.isalpha() for w in words):
        return words
    clean = ("".join(c for c in w if c.isalpha()) for w in words)
    return [w[k : k + SEGMENT] for w in clean for k in range(0, len(w), SEGMENT)]


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that lower-cased words can be cut into."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return [p for p in every if p == p.lower() and (p.removeprefix(MARK).isalpha() or p == MARK)]


class PieceTree:
    """Pieces as a tree of letters, walked for many places of many words at once."""

    def __init__(self, pieces: Sequence[str]):
        self.size = len(pieces)
        letters = sorted({c for p in pieces for c in p})
        # Code 0 ends a word and leads nowhere; letters of no piece share the next one.
        self.codes = np.ones(0x110000, np.int64)
        self.codes[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.codes[0] = 0
        self.width = len(letters) + 2
        code_of = {c: i + 2 for i, c in enumerate(letters)}
        steps: dict[int, int] = {}
        piece_of = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node * self.width + code_of[c]
                node = steps.get(key, -1)
                if node < 0:
                    node = steps[key] = len(piece_of)
                    piece_of.append(-1)
            piece_of[node] = number
        self.keys = np.array(sorted(steps), np.int64)
        self.children = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece_of = np.array(piece_of, np.int64)

    def matches(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, start, end, piece of every piece in every marked word, and of single letters that are none."""
        text = "".join(f"{MARK}{w}\0" for w in words)
        codes = self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.nonzero(codes)[0]
        node = np.zeros(len(at), np.int64)
        found, reach = [], 0
        while len(at) and len(self.keys):
            key = node * self.width + codes[at + reach]
            step = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[step] == key
            reach += 1
            if reach == 1:
                single = np.where(alive, self.piece_of[self.children[step]], -1)
                found.append((at, np.full(len(at), reach), np.where(single < 0, self.size, single)))
            at, node = at[alive], self.children[step[alive]]
            piece = self.piece_of[node]
            if reach > 1:
                whole = piece >= 0
                found.append((at[whole], np.full(int(whole.sum()), reach), piece[whole]))
        if not found:
            found.append((at, np.ones(len(at), np.int64), np.full(len(at), self.size)))
        at, length, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        return word[at], place[at], place[at] + length, piece


class Lattice:
    """All cuts of a list of distinct words into pieces, as edges in the order of their ends.

    A letter that is no piece by itself is an edge of its own, all with the piece number after the last.
    """

    def __init__(self, words: Sequence[str], tree: PieceTree):
        word, start, end, piece = tree.matches(words)
        order = np.argsort(end, kind="stable")
        self.word, self.start, self.end, self.piece = (x[order] for x in (word, start, end, piece))
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        steps = int(self.size.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(1, steps + 2))

    def forward(self, chance: np.ndarray) -> np.ndarray:
        """Summed probability of reaching each place of each word: words x places x languages."""
        reach = np.zeros((len(self.size), len(self.cuts), chance.shape[1]))
        reach[:, 0] = 1.0
        for k in range(len(self.cuts) - 1):
            edge = slice(self.cuts[k], self.cuts[k + 1])
            gained = reach[self.word[edge], self.start[edge]] * chance[self.piece[edge]]
            np.add.at(reach[:, k + 1], self.word[edge], gained)
        return reach

    def total(self, reach: np.ndarray) -> np.ndarray:
        return reach[np.arange(len(self.size)), self.size]

    def expected(self, chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, for words seen ``counts`` times (words x languages)."""
        reach = self.forward(chance)
        rest = np.zeros_like(reach)
        rest[np.arange(len(self.size)), self.size] = 1.0
        for k in range(len(self.cuts) - 2, -1, -1):
            edge = slice(self.cuts[k], self.cuts[k + 1])
            behind = rest[self.word[edge], self.end[edge]] * chance[self.piece[edge]]
            np.add.at(rest, (self.word[edge], self.start[edge]), behind)
        through = reach[self.word, self.start] * chance[self.piece] * rest[self.word, self.end]
        share = through / np.maximum(self.total(reach), 1e-300)[self.word] * counts[self.word]
        uses = np.zeros_like(chance)
        np.add.at(uses, self.piece, share)
        return uses


class LanguageModel:
    """Languages, pieces and a probability for each piece (rows) in each language; the last row is any other letter."""

    def __init__(self, languages: Sequence[str], pieces: Sequence[str], chance: np.ndarray):
        self.languages, self.chance = list(languages), chance
        self.pieces = list(pieces)
        self.tree = PieceTree(self.pieces)

    def log_words(self, words: Sequence[str], at_once: int = 20_000) -> np.ndarray:
        parts = [np.zeros((0, len(self.languages)))]
        # Words of like length share a lattice, so that few of its places are empty.
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(words), at_once):
            lattice = Lattice([words[i] for i in order[k : k + at_once]], self.tree)
            parts.append(np.log(np.maximum(lattice.total(lattice.forward(self.chance)), 1e-300)))
        scores = np.empty((len(words), len(self.languages)))
        scores[order] = np.concatenate(parts)
        return scores


class Predictor:
    """Scores texts with a model, remembering words up to a bound that only sets the speed."""

    def __init__(self, model: LanguageModel, most_words: int = 250_000):
        self.model, self.most_words = model, most_words
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.scores = np.zeros((0, len(self.model.languages)))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        if len(self.place) > self.most_words:
            self._forget()
        split = [words_in(t) for t in texts] if self.model.languages else [[] for _ in texts]
        sizes = np.array([len(part) for part in split], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.place.new:
            self.scores = np.concatenate([self.scores, self.model.log_words(self.place.new)])
            self.place.new = []
        languages, shares = [UNDETERMINED] * len(split), [0.0] * len(split)
        some = np.nonzero(sizes)[0]
        if len(some):
            totals = np.add.reduceat(self.scores[at], (np.cumsum(sizes) - sizes)[some], axis=0)
            best = totals.argmax(axis=1)
            share = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            for k, language, part in zip(some.tolist(), best.tolist(), share.tolist()):
                languages[k], shares[k] = self.model.languages[language], part
        return languages, shares


def learn(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE_DOCUMENTS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on ``labelled`` (text, lang), of which about ``sample`` documents per language are read as a whole.

    The sample is drawn by a hash of text and, where there is one, doc_id, so that rows of one text are drawn apart.
    """
    pieces = vocabulary_pieces(vocabulary)
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # One row per language.
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    spread = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in labelled.columns)), F.lit(1_000_003)) / 1_000_003
    chosen = F.lit(False)
    for lang in languages:
        chosen |= (F.col("lang") == lang) & (spread < min(1.0, sample / sizes[lang]))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for word, times in Counter(words_in(text)).items():
                    seen[word, number[lang]] += times
            words, tongues = zip(*seen) if seen else ((), ())
            columns = [pa.array(words, pa.string()), pa.array(tongues, pa.int64()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "language", "n"])

    counted = known.where(chosen).select("text", "lang").mapInArrow(count, "word string, language long, n long")
    totals = materialize(counted.groupBy("word", "language").agg(F.sum("n").alias("n")), "language-words")
    chance = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        now = chance

        def uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, total = PieceTree(pieces), np.zeros_like(now)
            for batch in slices(batches, 5000):
                lattice = Lattice(batch.column("word").to_pylist(), tree)
                counts = np.zeros((batch.num_rows, now.shape[1]))
                counts[np.arange(batch.num_rows), batch.column("language").to_numpy()] = batch.column("n").to_numpy()
                total += lattice.expected(now, counts)
            piece, language = np.nonzero(total)
            columns = [pa.array(piece), pa.array(language), pa.array(total[piece, language])]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "language", "uses"])

        expected = totals.mapInArrow(uses, "piece long, language long, uses double")
        # At most one row per piece and language.
        summed = expected.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.full(chance.shape, SMOOTHING)
        table[summed["piece"], summed["language"]] += summed["uses"]
        chance = table / table.sum(axis=0)
    return LanguageModel(languages, pieces, chance)


def identified(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Each row with lang_pred and score."""
    names = [free_name(documents.columns, c) for c in ("lang_pred", "score")]
    place = documents.columns.index("text")
    # At most the vocabulary for each language.
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.chance))
    schema = T.StructType(
        [*documents.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(LanguageModel(*shared.value))
        for batch in slices(batches):
            languages, shares = predictor.predict(batch.column(place).to_pylist())
            columns = [*batch.columns, pa.array(languages, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return documents.mapInArrow(scan, schema)


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(is_training("doc_id", 4, 2)).select("doc_id", "text", "lang")


def language_digest(documents: DataFrame, vocabulary: str) -> DataFrame:
    model = learn(training_rows(documents), vocabulary)
    held_out = (~is_training("doc_id", 4, 2)).alias("held_out")
    return identified(documents.select("doc_id", "text", held_out), model).drop("text")
