"""Near-duplicate vectors (operator 1) by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within squared distance 2 - 2c. Vectors are rotated to their principal
axes and split into blocks of few coordinates; the squared distance allowed is divided among the blocks in
proportion to the variance they hold. If a pair exceeded its budget in every block, it would exceed the
whole, so every link is within budget in at least one block: the union of the blocks' range joins holds all
links, and exact cosines of the original vectors, in double precision, decide among them.

Equal vectors are one class, so a third of all rows being copies is one vector to compare. Classes are cut
into tiles of bounded size along the leading axes, crowded cells by hash. Pairs of tiles whose bounding
boxes are farther apart than the budget in every block are skipped on their boxes alone; for the others
one task range-joins the blocks whose boxes allow it and verifies the union of candidates at once. A pair
of tiles returns the number of links of each class and a spanning forest of them, never all links of a
group. Tiles are stored once and meet in a nested-loop join that reads the stored partitions in pairs: none is
shuffled, and a task holds one partition of tiles. The work still grows with the square of the number of
different vectors where they do not cluster, since no block tells such vectors apart by more than its budget;
what is shuffled and stored grows with the rows.

A vector that is null, zero or holds a null or non-finite component links with nothing and is its own
component. Repeated rows are vectors of their own that link with each other. Shorter vectors count as filled
with zeros. A null id takes part, and names a component only if no other id does. An empty table gives an
empty result. Other columns are not read. The table is read once for its vectors and once for its ids; there 128 bits
of hashes stand for a vector, so that vectors cross one shuffle to become classes and one to become tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintageline.llm.common import materialize, slices
from vintageline.llm.components import components
from vintageline.llm.vectors import as_matrix, principal_axes, unit, usable, width_of

COSINE = 0.9
BLOCKS = 4
TILE = 4096
CUT_AXES = 3
# Candidates are found in single precision; budgets are widened by more than its error.
SLACK = 1e-4


def block_bounds(width: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def budgets(energy: np.ndarray, bounds: list[tuple[int, int]], cosine: float) -> list[float]:
    """Squared distance per block, in proportion to its variance, with slack."""
    whole = 2 - 2 * cosine
    return [whole * float(energy[a:b].sum() / energy.sum()) * (1 + SLACK) + SLACK * whole / len(bounds) for a, b in bounds]


def _tiled(classes: DataFrame, axes: np.ndarray, width: int, tile: int) -> DataFrame:
    """tile (long), node, copies, vectors per tile as lists, and the tile's bounding box in rotated coordinates."""
    cut = min(CUT_AXES, width)

    def leading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            turned = unit(as_matrix(batch.column("vector"), width)) @ axes[:, :cut]
            columns = [*batch.columns, *(pa.array(turned[:, k]) for k in range(cut))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"axis{k}" for k in range(cut))])

    schema = T.StructType(list(classes.schema.fields))
    for k in range(cut):
        schema = schema.add(f"axis{k}", "double")
    # Turned again rather than stored with the vectors; cells need the axes alone.
    turned = classes.mapInArrow(leading, schema)
    placed = materialize(turned.select("node", *(f"axis{k}" for k in range(cut))), "vector-axes")
    wanted = -(-placed.count() // tile)
    shares, left = [], wanted
    for k in range(cut):
        parts = max(1, round(left ** (1 / (cut - k))))
        left = -(-left // parts)
        shares.append([(i + 1) / parts for i in range(parts - 1)])
    cuts = [F.percentile_approx(f"axis{k}", at).alias(f"axis{k}") for k, at in enumerate(shares) if at]
    edges = placed.agg(*cuts).first().asDict() if cuts else {}
    cell = F.lit(0)
    for k, at in enumerate(shares):
        step = F.lit(0)
        for edge in edges.get(f"axis{k}") or []:
            step += (F.col(f"axis{k}") > edge).cast("int")
        cell = cell * (len(at) + 1) + step
    # One row per cell, about as many as tiles are wanted; crowded cells are cut further.
    sizes = placed.groupBy(cell.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).alias("part")
    numbered = turned.withColumn("cell", cell).join(F.broadcast(sizes), "cell", "left")
    tiles = numbered.select("cell", part, "node", "copies", "vector").groupBy("cell", "part").agg(
        F.collect_list(F.struct("node", "copies", "vector")).alias("rows")
    )
    number = (F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("tile")
    lists = tiles.select(number, *(F.col(f"rows.{c}").alias(c) for c in ("node", "copies", "vector")))
    exact = _stored_type(classes, "vector")

    def boxed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = as_matrix(batch.column("vector").flatten(), width)
            turned = unit(rows) @ axes
            columns = [
                *(batch.column(c) for c in ("tile", "node", "copies")),
                pa.array([rows.astype(exact).tobytes()], pa.binary()),
                pa.array([turned.min(axis=0).tolist()]),
                pa.array([turned.max(axis=0).tolist()]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "node", "copies", "vectors", "low", "high"])

    boxed_type = "tile long, node array<long>, copies array<long>, vectors binary, low array<double>, high array<double>"
    return materialize(lists.mapInArrow(boxed, boxed_type), "vector-tiles")


def _stored_type(table: DataFrame, vector: str) -> type:
    """Single precision holds the components of a float column exactly, double those of any other."""
    return np.float32 if table.schema[vector].dataType.elementType == T.FloatType() else np.float64


def _boxes_near(bounds: list[tuple[int, int]], budget: list[float]) -> Column:
    """Whether two boxes (low, high and other_low, other_high) are within budget in some block."""
    near = F.lit(False)
    for (a, b), most in zip(bounds, budget):
        part = [F.slice(c, a + 1, b - a) for c in ("low", "high", "other_low", "other_high")]
        gaps = F.zip_with(
            F.zip_with(part[2], part[1], lambda x, y: x - y),
            F.zip_with(part[0], part[3], lambda x, y: x - y),
            lambda x, y: F.greatest(x, y, F.lit(0.0)),
        )
        near |= F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= most
    return near


def _tie(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after joining the trees of u and v, pairwise."""
    while True:
        lower = np.minimum(root[u], root[v])
        if (root[u] == lower).all() and (root[v] == lower).all():
            return root
        np.minimum.at(root, root[u], lower)
        np.minimum.at(root, root[v], lower)
        while not (root[root] == root).all():
            root = root[root]


def tile_links(
    left: np.ndarray,
    right: np.ndarray,
    same: bool,
    axes: np.ndarray,
    bounds: list[tuple[int, int]],
    budget: list[float],
    cosine: float,
    rows: int = 512,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two tiles' vectors with at least this cosine; each pair once if the tiles are the same."""
    unit_left, unit_right = unit(left), unit(right)
    turned = [(u @ axes).astype(np.float32) for u in (unit_left, unit_right)]
    sides = []
    for (a, b), most in zip(bounds, budget):
        x, y = turned[0][:, a:b], turned[1][:, a:b]
        gap = np.maximum(0, np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)))
        if float(gap @ gap) <= most:
            ones = [np.ones((len(z), 1), np.float32) for z in (x, y)]
            squares = [np.einsum("ij,ij->i", z, z)[:, None] for z in (x, y)]
            # One product gives all squared distances of the block.
            sides.append((np.hstack([x, squares[0], ones[0]]), np.hstack([-2 * y, ones[1], squares[1]]).T.copy(), most))
    for at in range(0, len(left) if sides else 0, rows):
        candidate = np.zeros((len(left[at : at + rows]), len(right)), bool)
        for x, y, most in sides:
            candidate |= x[at : at + rows] @ y <= most
        if same:
            candidate &= np.arange(len(right))[None, :] > np.arange(at, at + len(candidate))[:, None]
        i, j = np.nonzero(candidate)
        i += at
        for k in range(0, len(i), 1 << 16):
            u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            found = np.einsum("ij,ij->i", unit_left[u], unit_right[v]) >= cosine
            yield u[found], v[found]


def vector_links(classes: DataFrame, axes: np.ndarray, energy: np.ndarray, cosine: float, tile: int) -> DataFrame:
    """node, root, links: for classes with links in a pair of tiles, their number there and a node they lead to."""
    width = len(energy)
    bounds = block_bounds(width, BLOCKS)
    budget = budgets(energy, bounds, cosine)
    tiles = _tiled(classes, axes, width, tile)
    exact = _stored_type(classes, "vector")
    mine = tiles.select("tile", "low", "high", *(F.col(c).alias(f"own_{c}") for c in ("node", "copies", "vectors")))
    other = tiles.select(
        F.col("tile").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"),
        "node", "copies", "vectors",
    )
    # Every tile meets those from itself on. A task reads two stored partitions of tiles and compares boxes first.
    meet = (F.col("tile") <= F.col("other")) & _boxes_near(bounds, budget)
    work = mine.hint("shuffle_replicate_nl").join(other, meet).drop("low", "high", "other_low", "other_high")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            get = {c: batch.column(c)[0] for c in batch.schema.names}
            same = get["tile"] == get["other"]
            a, b = (
                np.frombuffer(get[c].as_py(), exact).reshape(-1, width).astype(np.float64)
                for c in ("own_vectors", "vectors")
            )
            nodes_a, nodes_b = (np.asarray(get[c].values) for c in ("own_node", "node"))
            copies_a, copies_b = (np.asarray(get[c].values) for c in ("own_copies", "copies"))
            shift = 0 if same else len(a)
            nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
            copies = copies_a if same else np.concatenate([copies_a, copies_b])
            # Roots are places in node order, so a tree's root is its smallest node.
            order = np.argsort(nodes)
            place = np.argsort(order)
            root = np.arange(len(nodes))
            links = np.zeros(len(nodes), np.int64)
            for i, j in tile_links(a, b, same, axes, bounds, budget, cosine):
                u, v = i, j + shift
                links += np.bincount(u, copies[v], len(nodes)).astype(np.int64)
                links += np.bincount(v, copies[u], len(nodes)).astype(np.int64)
                root = _tie(root, place[u], place[v])
            hit = np.nonzero(links)[0]
            columns = [nodes[hit], nodes[order][root[place[hit]]], links[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "root", "links"])

    return work.mapInArrow(compare, "node long, root long, links long")


def near_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """One row per vector: ``key``, n_links, component_id (smallest id that links lead to), kept."""
    kind = "array<float>" if _stored_type(table, vector) is np.float32 else "array<double>"
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.withColumn("ok", usable("vector"))
    marks = [F.xxhash64(F.lit(seed), "vector").alias(f"mark{seed}") for seed in (1, 2)]
    classes = materialize(
        rows.where("ok")
        .groupBy("vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        .select(F.monotonically_increasing_id().alias("node"), "*", *marks),
        "vector-classes",
    )
    width = width_of(classes.withColumn("ok", F.lit(True)))
    named_by = classes.select("node", "copies", "first_id", "mark1", "mark2")
    if width:
        axes, energy = principal_axes(classes.withColumn("ok", F.lit(True)), width)
        found = materialize(
            vector_links(classes.select("node", "copies", "vector"), axes, energy, cosine, tile), "vector-links"
        )
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        tied = tied.select(F.col("node").alias("_node"), F.col("component"))
        joined = named_by.join(links, "node", "left").join(tied, F.col("node") == F.col("_node"), "left")
        known = joined.select(
            "mark1",
            "mark2",
            "first_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    else:
        known = named_by.select("mark1", "mark2", "first_id", F.lit(0).alias("n_links"), F.col("node").alias("component"))
    named = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = known.join(named, "component").select("mark1", "mark2", "n_links", "component_id")
    linked = rows.where("ok").select("id", *marks).join(by_class, ["mark1", "mark2"])
    alone = rows.where("NOT ok").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    result = linked.select("id", "n_links", "component_id").union(alone)
    return result.select(
        F.col("id").alias(key),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


LINKS_SQL = f"""
WITH RECURSIVE marked AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
           coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
    FROM embeddings),
good AS (SELECT * FROM marked WHERE ok),
links AS (
    SELECT a.r AS a, b.r AS b FROM good a JOIN good b
    ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
    SELECT r AS a, r AS b FROM marked
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN marked ON b = r GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, n.component_id, m.vec_id = n.component_id AS kept
FROM marked m JOIN named n ON n.a = m.r LEFT JOIN counted c ON c.a = m.r
"""
