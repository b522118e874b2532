"""Language-model scores (operator 7) by a backoff model over words, their pairs and triples.

Counting. Every distinct word of the training texts is counted, and every pair and triple of words that occurs
there ``LEAST_GRAM`` times or more is kept, whatever its words; so the model grows with the corpus, and no part
of it is sent to all tasks. Texts are held in blocks of about ``BLOCK_TOKENS``. A block sends its distinct
grams, hashed to 64 bits, and how often its training texts hold them to shards of the hash space as packed
sorted arrays; a shard adds up what all blocks sent and answers each block in the order in which it asked.
A gram is one entry per block, so none is hot, and shards are even, since hashes are.

1. Words and pairs are counted.
2. Triples of kept pairs are counted. The first block that holds a kept pair adds its part to the backoff
   weight of its first word.
3. The first block that holds a kept triple adds its part to the backoff weight of its first pair.
4. With these answers each block has all grams that its texts can reach, and scores them.

Blocks and answers are stored in the same buckets of blocks, so both cross the network once and are then read where
they lie. What is added up are whole numbers, so the order of blocks does not change a weight.

Scoring. A block's grams become a weighted automaton: its states are the contexts, its arcs the kept grams, and a
failure arc leads from each context to the next shorter one at the price of the backoff weight. Every text is
read once from left to right. Its state is carried from word to word; where the state has no arc for a word, failure
arcs are followed until one has, at last the empty context, which has an arc for every word.

Seen n-grams are discounted by ``DISCOUNT``; the backoff weights spread what is left over the words that were
not seen there, so the probabilities of all words after any context sum to one, unseen words together counting
as one more word.

A null or empty text is its end alone. Rows are scored one by one: repeated rows get equal scores, and train
as often as they occur. A null doc_id trains and is not held out. Without training texts every score is 0.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from vintageline.llm.common import is_training, slices
from vintageline.sources.snapshots import shared_folder

LEAST_GRAM = 2
BLOCK_TOKENS = 1_000_000
SHARD_TOKENS = 2_000_000
SMOOTHING = 0.1
DISCOUNT = 0.5
# Spark's own limit of buckets.
MOST_BUCKETS = 100_000
# Words of a long text that are read on end, texts and such parts being read side by side.
LANE = 512
# Hash that stands for the end of a text; a word that hashes to it is counted with it.
END = 0


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes lower and split at exactly the ASCII characters meant."""
    return text.encode().lower().split() if text else []


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that the bytes that say little shrink."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a context's hash and a word's."""
    mixed = context * np.uint64(0x9E3779B97F4A7C15) + word
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(32))


def _blocks(documents: DataFrame, most: int) -> DataFrame:
    """block, doc_ids, training, sizes, ids, words: some thousand texts as places in the block's sorted word hashes."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", is_training("doc_id", 10, 0).alias("training"), "text"
    )
    id_type = rows.schema["doc_id"].dataType

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        numbers: dict[bytes, int] = {}
        ids: list[int] = []
        sizes: list[int] = []

        def block() -> pa.RecordBatch:
            # Two words of one hash are one word.
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            words, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
            texts = place[np.array(ids, np.int64)].astype(np.int32)
            table = pa.Table.from_batches(held).combine_chunks()
            doc_ids, training = (table.column(c).combine_chunks() for c in ("doc_id", "training"))
            columns = [pa.array([table.column("row")[0].as_py()], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), c) for c in (doc_ids, training, pa.array(sizes, pa.int32()))]
            columns += [pa.array([packed(texts)], pa.binary()), pa.array([packed(words)], pa.binary())]
            for kept in (held, numbers, ids, sizes):
                kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "training", "sizes", "ids", "words"])

        for batch in slices(batches, 20):
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
                ids.append(-1)
                sizes.append(len(words) + 1)
            held.append(batch.select(["row", "doc_id", "training"]))
            if len(ids) >= most:
                yield block()
        if held:
            yield block()

    schema = StructType().add("block", "long").add("doc_ids", ArrayType(id_type)).add("training", ArrayType(BooleanType()))
    schema = schema.add("sizes", ArrayType(IntegerType())).add("ids", "binary").add("words", "binary")
    return rows.mapInArrow(build, schema)


def summed(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, places, values)
    return out


def _backoff(sums: np.ndarray, count: np.ndarray, shorter: np.ndarray | int) -> np.ndarray:
    """log10 of what the seen words leave of a context, by what they leave of the shorter one; 0 without seen words.

    ``sums`` holds twice the discounted counts of the seen words, and their part of ``shorter``.
    """
    seen, spread = sums
    count = np.maximum(2 * count, 1)
    return np.log10((count - seen) / count) - np.log10(np.where(seen > 0, shorter - spread, shorter) / np.maximum(shorter, 1))


class Automaton:
    """A block's contexts as states, its kept grams as arcs, and failure arcs at the price of the backoff weights.

    States: 0 the empty context, then every word, then every pair. A word's arc leaves the empty context for the
    word's state; a kept pair's leaves its first word's state, a kept triple's its first pair's, both for the
    state of their last pair. A failure arc leads from a pair to its second word, from a word to the empty context.
    ``no_arc`` leaves no state.
    """

    def __init__(self, after_word, after_pair, second, weights, contexts, kept, tail):
        words, pairs = len(after_word), len(after_pair)
        self.words = words
        self.pair_arcs, self.triple_arcs = words, words + pairs
        self.no_arc = words + pairs + len(tail)
        first, head = contexts
        pair_states = 1 + words + np.arange(pairs)
        self.failure = np.concatenate([[0], np.zeros(words, np.int64), 1 + second])
        self.backoff = np.concatenate([[0.0], after_word, after_pair])
        left = [np.zeros(words, np.int64), np.where(kept[0], 1 + first, -1), np.where(kept[1], pair_states[head], -1)]
        self.source = np.concatenate([*left, [-1]])
        self.target = np.concatenate([1 + np.arange(words), pair_states, pair_states[tail], [0]])
        self.weight = np.concatenate([*weights, [0.0]])

    def walk(self, arcs: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Cost of every place, texts being read side by side from left to right.

        ``arcs`` are the arcs of each place's word, of the pair and of the triple that end there. A text longer
        than ``LANE`` is read in parts; since a state is at most two words, a part that first reads the two words
        before it, without counting their cost, starts in the very state in which the part before it ended.
        """
        parts = -(-(stops - starts) // LANE)
        begin = np.repeat(starts, parts) + LANE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(begin + LANE, np.repeat(stops, parts))
        read = np.maximum(begin - 2, np.repeat(starts, parts))
        order = np.argsort(read - end, kind="stable")
        begin, end, read = begin[order], end[order], read[order]
        lengths = end - read
        cost = np.zeros(arcs.shape[1])
        state = np.zeros(len(read), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step))
            place, at = read[:live] + step, state[:live]
            paid = np.zeros(live)
            # Pairs first; then words, among them those that pairs have failed to.
            for length, least, most in ((2, self.words, len(self.failure)), (1, 0, self.words)):
                fails = np.nonzero((at > least) & (at <= most) & (self.source[arcs[length, place]] != at))[0]
                paid[fails] += self.backoff[at[fails]]
                at[fails] = self.failure[at[fails]]
            arc = arcs[(at > 0).astype(np.int8) + (at > self.words), place]
            counted = place >= begin[:live]
            cost[place[counted]] = (paid + self.weight[arc])[counted]
            state[:live] = self.target[arc]
        return cost


class _Block:
    """One block's texts, and what the answers so far say about them."""

    def __init__(self, row: dict, totals: tuple[int, int]):
        self.row = row
        self.words = unpacked(row["words"], np.uint64)
        self.ids = unpacked(row["ids"], np.int32).astype(np.int64)
        self.trains = np.repeat(np.array(row["training"], bool), row["sizes"])
        inner = self.words[self.ids] != END
        # Places where a pair or triple starts; pairs are named by their places in ``pairs``.
        self.at = np.nonzero(inner[:-1])[0]
        found = chained(self.words[self.ids[self.at]], self.words[self.ids[self.at + 1]])
        self.pairs, first, self.pair = np.unique(found, return_index=True, return_inverse=True)
        self.first, self.second = self.ids[self.at[first]], self.ids[self.at[first] + 1]
        self.totals = totals

    def weighed(self, places: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(places, self.trains[at], size).astype(np.int64)

    def ask_words(self):
        """Keys, and how often the training texts hold them; likewise pairs and triples."""
        return self.words, self.weighed(self.ids, np.arange(len(self.ids)), len(self.words))

    def ask_pairs(self):
        return self.pairs, self.weighed(self.pair, self.at, len(self.pairs))

    def take_counts(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.n, self.pair_n, self.owns_pair = words >> 1, pairs >> 1, (pairs & 1) > 0
        tokens, kinds = self.totals
        self.scale = np.log10(tokens + SMOOTHING * (kinds + 1))
        self.kept = self.pair_n >= LEAST_GRAM
        self.owns_pair &= self.kept
        # Triples of two kept pairs, by the number of the first one's occurrence; others are not kept.
        follows = np.nonzero(self.at[1:] == self.at[:-1] + 1)[0]
        self.long_at = follows[self.kept[self.pair[follows]] & self.kept[self.pair[follows + 1]]]
        middle = self.pair[self.long_at]
        found = chained(self.pairs[middle], self.words[self.ids[self.at[self.long_at] + 2]])
        self.triples, first, self.triple = np.unique(found, return_index=True, return_inverse=True)
        self.head, self.tail = middle[first], self.pair[self.long_at[first] + 1]

    def ask_triples(self):
        return self.triples, self.weighed(self.triple, self.at[self.long_at], len(self.triples))

    def ask_after_words(self):
        """Words before a pair, and this block's parts of twice the seen counts and of the shorter probabilities."""
        self.word_contexts = np.unique(np.concatenate([self.first[~self.kept], self.first[self.owns_pair]]))
        own, size = self.owns_pair, len(self.words)
        parts = (summed(self.first[own], w[own], size) for w in (2 * self.pair_n - 1, 10 * self.n[self.second] + 1))
        return self.words[self.word_contexts], *(p[self.word_contexts] for p in parts)

    def take_triples(self, answer: np.ndarray) -> None:
        self.triple_n = answer >> 1
        self.triple_kept = self.triple_n >= LEAST_GRAM
        self.owns_triple = ((answer & 1) > 0) & self.triple_kept
        # Whether a kept triple ends in the pair of each occurrence's second word.
        self.ends_triple = np.zeros(len(self.at), bool)
        self.ends_triple[self.long_at + 1] = self.triple_kept[self.triple]

    def ask_after_pairs(self):
        """As ``ask_after_words``, for kept pairs that a triple not kept goes on from."""
        follows = np.nonzero(self.at[1:] == self.at[:-1] + 1)[0]
        self.left = follows[self.kept[self.pair[follows]] & ~self.ends_triple[follows + 1]]
        own, size = self.owns_triple, len(self.pairs)
        self.pair_contexts = np.unique(np.concatenate([self.pair[self.left], self.head[own]]))
        parts = (summed(self.head[own], w[own], size) for w in (2 * self.triple_n - 1, 2 * self.pair_n[self.tail] - 1))
        return self.pairs[self.pair_contexts], *(p[self.pair_contexts] for p in parts)

    def automaton(self, of_words: np.ndarray, of_pairs: np.ndarray) -> Automaton:
        """States and arcs, by the sums asked for: twice the seen counts and the shorter probabilities of each context."""
        tokens, kinds = self.totals
        # Both sides in tenths of a count for words, in halves for pairs.
        after_word, after_pair = np.zeros(len(self.words)), np.zeros(len(self.pairs))
        at = self.word_contexts
        after_word[at] = _backoff(of_words, self.n[at], (10 * tokens + kinds + 1))
        at = self.pair_contexts
        after_pair[at] = _backoff(of_pairs, self.pair_n[at], 2 * self.n[self.second[at]])
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = (
                np.log10(self.n + SMOOTHING) - self.scale,
                np.log10((self.pair_n - DISCOUNT) / self.n[self.first]),
                np.log10((self.triple_n - DISCOUNT) / self.pair_n[self.head]),
            )
        return Automaton(
            after_word, after_pair, self.second, weights,
            (self.first, self.head), (self.kept, self.triple_kept), self.tail,
        )

    def scores(self, of_words: np.ndarray, of_pairs: np.ndarray) -> list[pa.Array]:
        """Columns of the block's texts."""
        automaton = self.automaton(of_words, of_pairs)
        sizes = np.array(self.row["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes
        # The arc that each place's word, pair and triple may have; those without a pair or triple have the last.
        arcs = np.full((3, len(self.ids)), automaton.no_arc, np.int32)
        arcs[0] = self.ids
        arcs[1, self.at + 1] = automaton.pair_arcs + self.pair
        arcs[2, self.at[self.long_at] + 2] = automaton.triple_arcs + self.triple
        cost = automaton.walk(arcs, starts, starts + sizes)
        base = (np.log10(self.n + SMOOTHING) - self.scale)[self.ids]
        sums = [np.add.reduceat(x, starts) for x in ((self.n > 0)[self.ids].astype(np.int64), base, cost)]
        return [pa.array(~np.array(self.row["training"], bool)), pa.array(sizes), *map(pa.array, sums)]


def placed(frame: DataFrame, name: str) -> DataFrame:
    """Write rows in buckets of blocks under the shared folder and read them back: joins of such tables need no shuffle.

    There are as many buckets as shuffles have partitions. The bucketed table leaves the catalog at once; its files stay.
    """
    spark = frame.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = frame.repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet").option("compression", "zstd")
    writer.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


ASKED = "block long, shard long, keys binary, a binary, b binary"
ANSWERED = "block long, shard long, answer binary, found long"


def _sent(number: int, first_shard: int, shards: int, keys: np.ndarray, *parts: np.ndarray) -> pa.RecordBatch:
    """A row per shard that some of the keys belong to, with these in order and their parts: counts, or two sums."""
    order = np.argsort(keys)
    keys = keys[order]
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    found, starts = np.unique(shard, return_index=True)
    edges = [*starts.tolist(), len(keys)]
    pieces = list(zip(edges, edges[1:]))
    columns = [np.full(len(found), number), found + first_shard]
    columns += [pa.array([packed(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in pieces], pa.binary())]
    columns += [pa.array([packed(p[order[x:y]]) for x, y in pieces], pa.binary()) for p in parts]
    if len(parts) == 1:
        columns.append(pa.nulls(len(found), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "shard", "keys", "a", "b"])


def _received(answers: list[dict] | None, first_shard: int, shards: int, keys: np.ndarray, parts: int = 1) -> np.ndarray:
    """Answers, sorted by shard, in the order of the keys asked for; so many numbers for each key."""
    out = np.zeros((parts, len(keys)), np.int64)
    found = [unpacked(a["answer"], np.int64).reshape(parts, -1) for a in answers or [] if first_shard <= a["shard"] < first_shard + shards]
    if found:
        out[:, np.argsort(keys)] = np.concatenate(found, axis=1)
    return out if parts > 1 else out[0]


def _counted(places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the count of each key, plus one for the first block that has it in training texts."""
    total = np.bincount(places, n).astype(np.int64)
    trained = np.nonzero(n > 0)[0][::-1]
    first = np.full(len(total), -1)
    first[places[trained]] = trained
    return 2 * total[places] + (first[places] == np.arange(len(places)))


def answered(asked: DataFrame, name: str) -> DataFrame:
    """What each shard answers to each block, and in one of its rows how many keys were found in training texts."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in slices(batches, 50):
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
            edges = np.cumsum([0, *map(len, keys)]).tolist()
            places = np.unique(np.concatenate(keys), return_inverse=True)[1]
            if rows[0]["b"] is None:
                answers = _counted(places, np.concatenate([unpacked(r["a"], np.int64) for r in rows]))
                found, answers = int((answers & 1).sum()), answers[None]
            else:
                sent = (np.concatenate([unpacked(r[c], np.int64) for r in rows]) for c in "ab")
                found, answers = 0, np.stack([summed(places, x, edges[-1])[places] for x in sent])
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("block", "shard")]
            columns += [pa.array([packed(answers[:, x:y].ravel()) for x, y in zip(edges, edges[1:])], pa.binary())]
            columns += [pa.array([found, *[0] * (len(rows) - 1)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "shard", "answer", "found"])

    sorted_rows = asked.repartition("shard").sortWithinPartitions("shard", "block")
    return placed(sorted_rows.mapInArrow(work, ANSWERED), name)


def scored(documents: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    blocks = placed(_blocks(documents, block_tokens), "text_blocks")
    trained = F.aggregate(
        F.zip_with("sizes", "training", lambda size, t: F.when(t, size).otherwise(0).cast("long")),
        F.lit(0).cast("long"),
        lambda total, size: total + size,
    )
    all_tokens, tokens = blocks.agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda total, size: total + size)), F.sum(trained)
    ).first()
    tokens = tokens or 0
    # Counts, and weights behind them, have so many shards each.
    shards = 1 + (all_tokens or 0) // shard_tokens

    def beside(*answers: DataFrame) -> DataFrame:
        rows = blocks
        for k, answer in enumerate(answers):
            by_block = answer.groupBy(F.col("block").alias("of")).agg(
                F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias(f"answers{k}")
            )
            rows = rows.join(by_block, F.col("block") == F.col("of"), "left").drop("of")
        return rows

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array]]:
        for batch in slices(batches, 1):
            yield batch.drop_columns(["doc_ids"]).to_pylist()[0], batch.column("doc_ids").flatten()

    def told(row: dict, totals: tuple[int, int], rounds: int) -> _Block:
        """A block with the answers of the first rounds and what it asked after them."""
        block = _Block(row, totals)
        counts = (_received(row["answers0"], s, shards, keys) for s, keys in ((0, block.words), (shards, block.pairs)))
        block.take_counts(*counts)
        if rounds > 1:
            block.take_triples(_received(row["answers1"], 0, shards, block.triples))
        return block

    def ask_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in each(batches):
            block = _Block(row, (0, 0))
            yield _sent(row["block"], 0, shards, *block.ask_words())
            yield _sent(row["block"], shards, shards, *block.ask_pairs())

    counts = answered(blocks.mapInArrow(ask_counts, ASKED), "gram_counts")
    kinds = counts.where(F.col("shard") < shards).agg(F.sum("found")).first()[0] or 0
    totals = (tokens, kinds)

    def ask_triples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in each(batches):
            block = told(row, totals, 1)
            yield _sent(row["block"], 0, shards, *block.ask_triples())
            yield _sent(row["block"], shards, shards, *block.ask_after_words())

    triples = answered(beside(counts).mapInArrow(ask_triples, ASKED), "triple_counts")

    def ask_after_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in each(batches):
            yield _sent(row["block"], shards, shards, *told(row, totals, 2).ask_after_pairs())

    weights = answered(beside(counts, triples).mapInArrow(ask_after_pairs, ASKED), "pair_weights")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc_ids in each(batches):
            block = told(row, totals, 2)
            words, pairs = block.ask_after_words()[0], block.ask_after_pairs()[0]
            of_words = _received(row["answers1"], shards, shards, words, 2)
            of_pairs = _received(row["answers2"], shards, shards, pairs, 2)
            columns = [doc_ids, *block.scores(of_words, of_pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    result = documents.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long")
    result = result.add("base_score", "double").add("score", "double")
    found = beside(counts, triples, weights).mapInArrow(score, result)
    return found.select(*names[:4], F.lit(tokens).cast("long").alias("train_tokens"), *names[4:])
