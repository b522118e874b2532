"""Token ids of texts, by a public tokenizer whose words never cross white space."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Callable, Sequence
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ASCII punctuation behind a letter is a token run of its own; an apostrophe may begin a contraction.
_TAIL = re.compile(r"(?<=[a-z])[!-&(-/:-@\[-`{-~]+$")
_SAMPLE = "The QUICK\tbrown  fox's 3rd\n\njump, (over)  42 dogs!? naïve Ärger don't"
# Words encoded in one call; their ids are told apart by the mark at the end of a word.
_JOINED = 100


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words between ASCII white space, each occurrence's number among them in the order of the
    texts, and the number of words of each text. Null texts have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:  # white space at an end of a text
        real = at != words.index("")
        text = np.repeat(np.arange(len(per_text)), per_text)[real]
        at, per_text = at[real], np.bincount(text, minlength=len(per_text))
    return words, at, per_text


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, one after the other, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, the next free one from 256 otherwise."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Places(dict):
    """Gives every word that it is asked for and does not know the next place."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordStore:
    """Integers of every word met, up to a bound that only sets the speed.

    ``learn`` gives a list of words their integers, as bytes of int32 each. ``places`` numbers words; the
    integers of place p are ``values[ends[p] : ends[p + 1]]``.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most_words: int, most_values: int):
        self.learn, self.most_words, self.most_values = learn, most_words, most_values
        self._start([], np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _start(self, words: list[str], sizes: np.ndarray, values: np.ndarray) -> None:
        self.place = dict(zip(words, range(len(words))))
        self.met = np.ones(len(words), np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.values = values

    def _forget(self) -> None:
        """Keep the half of the words that most calls met."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.most_words // 2])
        words = list(self.place)
        sizes = np.diff(self.ends)[kept]
        values = self.values[spread(self.ends[kept], sizes)]
        self._start([words[k] for k in kept.tolist()], sizes, values)
        self.kept(kept)

    def kept(self, places: np.ndarray) -> None:
        """Called when only the words at these places are kept, in this order."""

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.most_words or len(self.values) > self.most_values:
            self._forget()
        known = self.place
        new = [w for w in words if w not in known]
        if new:
            found = self.learn(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.values = np.concatenate([self.values, np.frombuffer(b"".join(found), np.int32)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.met[places] += 1
        return places


def word_tokenizer(path: str):
    """The tokenizer at ``path``; one that keeps case, joins across white space or does not mark word ends is refused."""
    # Tasks already fill the cores.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        suffix = json.load(file)["model"].get("end_of_word_suffix")
    whole = tokenizer.encode(_SAMPLE, add_special_tokens=False).ids
    parts = [tokenizer.encode(w.lower(), add_special_tokens=False).ids for w in re.split(r"[\x20\x09-\x0D]+", _SAMPLE)]
    if not suffix or whole != list(chain.from_iterable(parts)):
        raise ValueError(f"{path} does not encode lower-cased words one by one, with a mark at their ends")
    return tokenizer, suffix


class WordEncoder:
    """Encodes texts word by word and remembers words.

    ``encode`` returns the ids of all texts in one array, and where each text's ids end. The tokenizer lowers
    case itself; lowering ASCII letters first, and setting off punctuation behind them, only makes fewer
    different words. Strings of special tokens in a text are ordinary text. A null text is empty.
    """

    def __init__(self, path: str, most_words: int = 280_000, most_ids: int = 4_200_000):
        self.tokenizer, suffix = word_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.store = WordStore(self._learn, most_words, most_ids)
        # Ids of parts of words, as the bytes of their numbers.
        self.parts: dict[str, bytes] = {}
        self.most_parts = most_words // 2

    def _learn_parts(self, parts: list[str]) -> None:
        """A run of lower-case letters or of punctuation ends in one final token, so many are encoded as one text."""
        runs = [p for p in parts if _one_run(p)]
        others = [p for p in parts if not _one_run(p)]
        encode = self.tokenizer.encode_batch_fast
        joined = [" ".join(runs[k : k + _JOINED]) for k in range(0, len(runs), _JOINED)]
        found = [np.array(e.ids, np.int32) for e in encode(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = (np.nonzero(self.final[ids])[0] + 1).tolist()
        if len(ends) != len(runs):
            raise AssertionError(f"{len(runs)} words have {len(ends)} ends")
        self.parts.update((p, ids[a:b].tobytes()) for p, a, b in zip(runs, [0, *ends], ends))
        rest = encode(others, add_special_tokens=False)
        self.parts.update((p, np.array(e.ids, np.int32).tobytes()) for p, e in zip(others, rest))

    def _learn(self, words: list[str]) -> list[bytes]:
        tails = [None if w.isalpha() else _TAIL.search(w) for w in words]
        split = [(w[: t.start()], t.group()) if t else (w, "") for w, t in zip(words, tails)]
        if len(self.parts) > self.most_parts:
            self.parts = {}
        parts = self.parts
        self._learn_parts([p for p in dict.fromkeys(chain.from_iterable(split)) if p and p not in parts])
        return [parts[a] + parts[b] if b else parts[a] if a else b"" for a, b in split]

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        words, at, per_text = distinct_words(pc.ascii_lower(texts))
        store = self.store
        places = store.places(words)
        starts, sizes = store.ends[places], store.ends[places + 1] - store.ends[places]
        ids = store.values[spread(starts[at], sizes[at])]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        return ids, ends[np.cumsum(per_text)] if len(per_text) else ends[:0]


def _one_run(part: str) -> bool:
    """Lower-case letters only, or ASCII punctuation only: the tokenizer takes it as it is and in one piece."""
    if part.isalpha():
        return part.isascii() or (part == part.lower() and is_normalized("NFC", part))
    return part.isascii() and part.isprintable() and "'" not in part and not any(map(str.isalnum, part))


def worker_state(name: str) -> dict:
    """What a worker process keeps under a name from task to task. Functions of this subpackage arrive by value,
    with globals of their own for every task, so this lives in a module made for it."""
    module = sys.modules.setdefault("vintageline_worker_state", types.ModuleType("vintageline_worker_state"))
    return vars(module).setdefault(name, {})


def worker_encoder(path: str, most_words: int = 280_000) -> WordEncoder:
    """The worker process's own encoder, which keeps its words from task to task."""
    kept = worker_state("word_encoders")
    if (path, most_words) not in kept:
        kept[path, most_words] = WordEncoder(path, most_words, 15 * most_words)
    return kept[path, most_words]
