"""Approximate nearest neighbours (operator 3): a graph by NN-descent, searched greedily.

Building. Vectors that share a cell of random hyperplanes, and groups dealt at random, are compared first and give
every vector a list of ``DEGREE`` neighbours; the random groups see to it that outliers and small groups have full
lists too, so a query finds as many rows as asked for, or all others if they are fewer. Each round then joins the lists with themselves: the neighbours of a vector, and those
that have it as a neighbour, are compared with each other if the list entry of either is new, and every
list keeps its best. Rounds end when few entries change. Searching. A query starts at its own vector and
holds a beam of the best vectors seen; every round expands all beam members not expanded yet, until none is
left. The exact cosine of the original vectors in double precision ranks the whole beam.

Every vector is indexed. Equal vectors are one node, so copies do not fill each other's lists; the copies
themselves are put in when answers are written. Comparisons inside the graph use unit vectors in single precision, so
that differences inside tight groups count; equal ones are taken in the order of a hash. A vector that very many
have as a neighbour is joined in portions of ``PORTION``, dealt anew in every round, in one pass over its sorted rows,
so no list is ever held whole. Rounds are written to the shared folder.

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part.
Shorter vectors count as filled with zeros. Repeated rows are candidates of their own; a query row is not its
own candidate. Ties go to the smaller id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintageline.llm.common import materialize, slices
from vintageline.llm.vectors import as_matrix, unit, vector_rows, width_of

DEGREE = 24
BEAM = 160
PORTION = 256
TABLES = 4
SEED = 7
SETTLED = 0.03
MOST_ROUNDS = 12


def encoded(rows: np.ndarray) -> list[bytes]:
    """Unit vectors in single precision."""
    return [row.tobytes() for row in rows.astype(np.float32)]


def decoded(codes: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.float32).reshape(-1, width)


def portions(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of equal ``point`` in rows sorted by it, in portions of at most ``most``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        points = batch.column("point").to_numpy()
        edges = [0, *(np.nonzero(points[1:] != points[:-1])[0] + 1).tolist(), len(points)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[0].column("point")[0].as_py() != points[a]:
                yield pa.Table.from_batches(held)
                held = []
            while a < b:
                room = most - sum(h.num_rows for h in held)
                held.append(batch.slice(a, min(room, b - a)))
                a += min(room, b - a)
                if room <= held[-1].num_rows:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def compared(members: DataFrame, width: int, degree: int, turn: int) -> DataFrame:
    """node, other, near: for each member of a point its best others there that could enter its list.

    ``members`` has point, node, fresh, least (a list's worst entry, once full) and code;
    ``turn`` says how members are dealt to portions.
    """

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            node, other, near = (np.concatenate([o[k] for o in out]) for k in range(3))
            # The same pair may meet at many points; one row of it is enough.
            order = np.lexsort((other, node))
            node, other, near = node[order], other[order], near[order]
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
            out.clear()
            columns = [pa.array(c[first]) for c in (node, other, near)]
            return pa.RecordBatch.from_arrays(columns, names=["node", "other", "near"])

        for group in portions(batches, PORTION):
            if group.num_rows < 2:
                continue
            fresh = group.column("fresh").to_numpy()
            if not fresh.any():
                continue
            node = group.column("node").to_numpy()
            rows = decoded(group.column("code").combine_chunks(), width)
            near = rows @ rows.T
            allowed = (fresh[:, None] | fresh[None, :]) & (near >= group.column("least").to_numpy()[:, None])
            allowed &= node[:, None] != node[None, :]
            near = np.where(allowed, near, -9.0).astype(np.float32)
            if near.shape[1] > degree:
                cut = np.partition(near, near.shape[1] - degree, axis=1)[:, near.shape[1] - degree]
                allowed &= near >= cut[:, None]
            i, j = np.nonzero(allowed)
            out.append((node[i], node[j], near[i, j]))
            if sum(len(o[0]) for o in out) > 500_000:
                yield flushed()
        if out:
            yield flushed()

    sorted_members = members.repartition("point").sortWithinPartitions("point", F.xxhash64("node", F.lit(turn)))
    return sorted_members.mapInArrow(best, "node long, other long, near float")


def merged(lists: DataFrame | None, found: DataFrame, degree: int) -> DataFrame:
    """node, other, near, fresh, least: the best ``degree`` entries of each node's list."""
    new = found.select("node", "other", "near", F.lit(True).alias("fresh"))
    both = new if lists is None else new.union(lists.select("node", "other", "near", F.lit(False)))
    entries = both.groupBy("node", "other").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("near").desc(), F.xxhash64("node", "other")))
    kept = entries.withColumn("place", place).where(F.col("place") <= degree)
    of_node = Window.partitionBy("node")
    full = F.count(F.lit(1)).over(of_node) == degree
    least = F.when(full, F.min("near").over(of_node)).otherwise(F.lit(-2.0)).cast("float")
    return kept.select("node", "other", "near", "fresh", least.alias("least"))


def _both_ways(lists: DataFrame, *extra: Column) -> DataFrame:
    turned = lists.select(F.col("other").alias("point"), F.col("node").alias("node"), *extra)
    return lists.select(F.col("node").alias("point"), F.col("other").alias("node"), *extra).union(turned)


def neighbour_graph(codes: DataFrame, width: int, count: int, degree: int = DEGREE) -> DataFrame:
    """Lists of near neighbours, as node, other, near. ``codes`` has node and code."""
    bits = max(1, int(np.log2(max(2, count / (PORTION / 2)))))
    # Random groups fit in a portion each; up to PORTION - 1 vectors are one group.
    groups = max(1, count // (PORTION // 2)) if count >= PORTION else 1
    planes = np.random.default_rng(SEED).normal(size=(width, bits * TABLES)).astype(np.float32)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            side = decoded(batch.column("code"), width) @ planes > 0
            for t in range(TABLES + 1):
                own = side[:, t * bits : (t + 1) * bits]
                cell = own @ (1 << np.arange(bits, dtype=np.int64)) if t < TABLES else batch.column("dealt").to_numpy()
                point = cell * (TABLES + 1) + t
                size = batch.num_rows
                columns = [pa.array(point), batch.column("node"), pa.array(np.ones(size, bool))]
                columns += [pa.array(np.full(size, -2, np.float32)), batch.column("code")]
                yield pa.RecordBatch.from_arrays(columns, names=["point", "node", "fresh", "least", "code"])

    member_type = "point long, node long, fresh boolean, least float, code binary"
    dealt = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(groups)).alias("dealt")
    start = codes.select("node", "code", dealt).mapInArrow(cells, member_type)
    lists = materialize(merged(None, compared(start, width, degree, 0), degree), "neighbours")
    for turn in range(1, MOST_ROUNDS + 1):
        least = lists.groupBy(F.col("node").alias("of")).agg(F.min("least").alias("least"))
        known = codes.join(least, F.col("node") == F.col("of"), "left").select(
            "node", "code", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least")
        )
        met = _both_ways(lists, F.col("fresh")).groupBy("point", "node").agg(F.max("fresh").alias("fresh"))
        members = met.join(known, "node").select("point", "node", "fresh", "least", "code")
        lists = materialize(merged(lists, compared(members, width, degree, turn), degree), "neighbours")
        fresh, entries = lists.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        if fresh <= SETTLED * entries:
            break
    return lists.select("node", "other", "near")


def searched(graph: DataFrame, codes: DataFrame, starts: DataFrame, width: int, beam: int = BEAM) -> DataFrame:
    """start, node, near: the beam of every start node once it has nothing left to expand, itself included."""
    paths = materialize(_both_ways(graph).distinct(), "paths")
    asked = materialize(starts.join(codes, F.col("start") == F.col("node")).select("start", "code"), "asked")
    held = asked.select(
        "start", F.col("start").alias("node"), F.lit(1.0).cast("float").alias("near"), F.lit(False).alias("done"),
        F.lit(-2.0).cast("float").alias("worst"),
    )

    def closeness(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            asked_rows, rows = (decoded(batch.column(c), width) for c in ("asked_code", "code"))
            near = np.einsum("ij,ij->i", asked_rows, rows).astype(np.float32)
            better = near >= batch.column("worst").to_numpy()
            kept = batch.select(["start", "node"]).filter(pa.array(better))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near[better])], names=["start", "node", "near"])

    order = Window.partitionBy("start").orderBy(F.col("near").desc(), F.xxhash64("start", "node"))
    of_start = Window.partitionBy("start")
    while True:
        reached = (
            held.where("NOT done")
            .select("start", F.col("node").alias("point"))
            .join(paths, "point")
            .select("start", "node")
            .distinct()
        )
        worst = held.groupBy("start").agg(F.min("worst").alias("worst"))
        about = asked.join(worst, "start").select("start", F.col("code").alias("asked_code"), "worst")
        seen = reached.join(codes, "node").join(about, "start").mapInArrow(closeness, "start long, node long, near float")
        both = held.select("start", "node", "near", F.lit(True).alias("done")).union(
            seen.select("start", "node", "near", F.lit(False))
        )
        once = both.groupBy("start", "node").agg(F.max("near").alias("near"), F.max("done").alias("done"))
        best = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= beam)
        full = F.count(F.lit(1)).over(of_start) == beam
        worst_now = F.when(full, F.min("near").over(of_start)).otherwise(F.lit(-2.0)).cast("float")
        held = materialize(best.select("start", "node", "near", "done", worst_now.alias("worst")), "beam")
        if held.where("NOT done").isEmpty():
            return held.select("start", "node", "near")


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    degree: int = DEGREE,
    beam: int = BEAM,
) -> DataFrame:
    """query_id, rank, ``key``, score: the k nearest rows found for every row that ``queries`` chooses (over column id)."""
    rows = vector_rows(table, key, vector).where("ok AND id IS NOT NULL")
    width = max(1, width_of(rows))
    nodes = rows.groupBy("vector").agg(F.min("row").alias("node"))
    nodes = materialize(nodes, "vector-nodes")

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            short = encoded(unit(as_matrix(batch.column("vector"), width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(short, pa.binary())], names=["node", "code"]
            )

    codes = materialize(nodes.select("node", "vector").mapInArrow(code, "node long, code binary"), "vector-codes")
    own = rows.join(nodes, "vector").select("row", "id", "node")
    own = materialize(own, "vector-members")
    asked = own.where(queries).select("row", F.col("id").alias("query_id"), F.col("node").alias("start"))
    graph = neighbour_graph(codes, width, codes.count(), degree)
    found = searched(graph, codes, asked.select("start").distinct(), width, beam)
    vectors = nodes.select("node", F.col("vector").alias("theirs"))
    exact = found.select("start", "node").join(vectors, "node").join(
        nodes.select(F.col("node").alias("start"), F.col("vector").alias("mine")), "start"
    )

    def cosine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            mine, theirs = (as_matrix(batch.column(c), width) for c in ("mine", "theirs"))
            lengths = np.linalg.norm(mine, axis=1) * np.linalg.norm(theirs, axis=1)
            score = np.einsum("ij,ij->i", mine, theirs) / lengths
            yield pa.RecordBatch.from_arrays(
                [batch.column("start"), batch.column("node"), pa.array(score)], names=["start", "node", "score"]
            )

    scored = exact.select("start", "node", "mine", "theirs").mapInArrow(cosine, "start long, node long, score double")
    # Of a node's copies only the first k + 1 can be among the k nearest, the query itself being one at most.
    copy = F.row_number().over(Window.partitionBy("node").orderBy("id", "row"))
    copies = own.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("node", "row", "id")
    answers = (
        asked.withColumnRenamed("row", "query_row")
        .join(scored, "start")
        .join(copies, "node")
        .where("row <> query_row")
    )
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id", "row"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score"
    )


def nearest_digest(table: DataFrame) -> DataFrame:
    return nearest(table, F.col("id") % 50 == 0)
