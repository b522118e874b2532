"""Operators on vectors against comparisons of all pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintageline.llm import embedding_dedup, neighbours

FOLDER = "/root/testdata/sf0.001"
VECTOR_TYPE = "vec_id long, embedding array<float>, label int, row string, vector string, node int"


def odd_vectors(spark):
    """Clusters, copies, repeated rows, nulls, zeros and numbers that are none."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16))
    rows = []
    for k in range(90):
        v = centres[k % 6] + rng.normal(size=16) * (0.05 + 0.15 * (k % 4))
        rows.append((k, v.astype(np.float32).tolist()))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (0, rows[0][1]), (202, [2 * x for x in rows[1][1]])]
    rows += [
        (300, None),
        (301, [0.0] * 16),
        (302, [None, *rows[2][1][1:]]),
        (303, [float("nan"), *rows[2][1][1:]]),
        (304, [float("inf"), *rows[2][1][1:]]),
        (305, []),
        (None, rows[5][1]),
    ]
    return spark.createDataFrame([(i, v, None, "x", "y", 1) for i, v in rows], VECTOR_TYPE)


def usable(vector):
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def cosines(vectors):
    matrix = np.array(vectors, np.float64)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    return matrix @ matrix.T


@pytest.mark.parametrize("table", ["odd", "small"])
@pytest.mark.parametrize("tile", [16, 4096])
def test_links_match_all_pairs(spark, table, tile):
    frame = odd_vectors(spark) if table == "odd" else spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    good = [k for k, (_, v) in enumerate(rows) if usable(v)]
    near = cosines([rows[k][1] for k in good]) >= 0.9
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(good), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    expected = collections.Counter()
    for place, k in enumerate(good):
        ids = [rows[good[j]][0] for j in np.nonzero(reach[place])[0]]
        expected[rows[k][0], int(near[place].sum()), min((i for i in ids if i is not None), default=None)] += 1
    for k, (i, v) in enumerate(rows):
        if not usable(v):
            expected[i, 0, i] += 1
    found = embedding_dedup.near_vectors(frame, tile=tile).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in found) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_no_vector_is_shuffled_once_for_each_pair_of_tiles(spark, monkeypatch):
    plans = {}
    stored = embedding_dedup.materialize

    def watched(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return stored(frame, name)

    monkeypatch.setattr(embedding_dedup, "materialize", watched)
    found = embedding_dedup.near_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), tile=64)
    assert "CartesianProduct" in plans["vector-links"] and "Exchange" not in plans["vector-links"]
    # Of the vectors' own shuffles one makes classes and one makes tiles; ids meet their class without them.
    last = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(vector" not in last and "mark1" in last


def test_every_link_is_within_budget_in_some_block():
    rng = np.random.default_rng(2)
    energy = np.sort(rng.random(16))[::-1]
    bounds = embedding_dedup.block_bounds(16, 4)
    most = embedding_dedup.budgets(energy, bounds, 0.9)
    assert sum(most) >= 0.2
    a = rng.normal(size=(2000, 16))
    b = a + rng.normal(size=a.shape) * 0.3
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    linked = (a * b).sum(1) >= 0.9
    inside = np.zeros(len(a), bool)
    for (x, y), limit in zip(bounds, most):
        inside |= ((a[:, x:y] - b[:, x:y]) ** 2).sum(1) <= limit
    assert linked.any() and inside[linked].all()


def test_neighbours_of_a_table(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in frame.collect())
    ids = [i for i, _ in rows]
    near = cosines([v for _, v in rows])
    np.fill_diagonal(near, -2)
    found = collections.defaultdict(list)
    for r in neighbours.nearest_digest(frame).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(found) == [i for i in ids if i % 50 == 0]
    hits = 0
    for query, answers in found.items():
        row = near[ids.index(query)]
        answers.sort()
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(row[ids.index(i)], abs=1e-12) for _, i, s in answers)
        hits += len({i for _, i, _ in answers} & {ids[k] for k in np.argsort(-row)[:5]})
    assert hits >= 0.9 * 5 * len(found)


def test_neighbours_of_odd_vectors(spark):
    frame = odd_vectors(spark)
    found = neighbours.nearest(frame, F.col("id").isin(0, 7, 300)).collect()
    by_query = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.rank):
        by_query[r.query_id].append((r.vec_id, r.score))
    assert set(by_query) == {0, 7}
    # Vector 0 is there twice, each time with the other row and the two other copies before all else.
    assert len(by_query[0]) == 10
    assert collections.Counter(i for i, _ in by_query[0])[200] == 2
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if usable(r.embedding) and r.vec_id is not None]
    near = cosines([v for _, v in rows])
    seven = [i for i, _ in rows].index(7)
    order = sorted((-near[seven][k], rows[k][0]) for k in range(len(rows)) if k != seven)[:5]
    assert [i for i, _ in by_query[7]] == [i for _, i in order]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    answers = neighbours.nearest_digest(few).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(answers, key=lambda r: r.rank)] == [(0, 1, 2), (0, 2, 1)]
    none = few.where("vec_id < 0")
    assert embedding_dedup.near_vectors(none).collect() == []
    assert neighbours.nearest_digest(none).collect() == []
    only_bad = spark.createDataFrame([(0, None), (4, [0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in embedding_dedup.near_vectors(only_bad).collect()} == {(0, 0, 0, True), (4, 0, 4, True)}
    assert neighbours.nearest_digest(only_bad).collect() == []


def test_outliers_and_small_groups_have_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = [(centres[k % 6] + rng.normal(size=16) * 0.01).tolist() for k in range(600)]
    rows += (rng.normal(size=(20, 16)) * 5).tolist()
    small = rng.normal(size=16)
    rows += [(small + rng.normal(size=16) * 0.01).tolist() for _ in range(3)]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    found = collections.Counter(r.query_id for r in neighbours.nearest(frame, F.col("id") >= 600).collect())
    assert found == {k: 5 for k in range(600, 623)}
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, -2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest_digest(two).collect()] == [(0, 1)]


def test_neighbours_inside_groups_of_near_copies(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(1200, 64))
    for start, noise in ((0, 0.1), (400, 0.03)):  # mean cosines of about 0.99 and 0.999
        rows[start : start + 400] = rows[start] + rng.normal(size=(400, 64)) * noise
    rows = rows.astype(np.float32)
    near = cosines(rows)
    np.fill_diagonal(near, -2)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    hits = collections.Counter()
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0).collect():
        hits[r.query_id // 400] += r.vec_id in np.argsort(-near[r.query_id])[:5]
    print({g: hits[g] / 100 for g in range(3)})
    assert hits[0] >= 90 and hits[1] >= 90
