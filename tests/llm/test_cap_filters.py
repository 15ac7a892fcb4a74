import numpy as np
from pyspark.sql import functions as F

from harborline.llm.cap_filters import near_vectors
from harborline.llm.queries import op9_embeddings
from tests.conftest import SF
from tests.llm import brute


def expected(ids, matrix, cosine=0.95):
    units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = units @ units.T >= cosine
    np.fill_diagonal(near, False)
    pairs = np.argwhere(np.triu(near))
    order = np.argsort(ids)
    rank = np.argsort(order)
    root = brute.smallest_reachable(len(ids), [(rank[a], rank[b]) for a, b in pairs])
    return {ids[i]: (int(near[i].sum()), ids[order[root[rank[i]]]]) for i in range(len(ids))}, len(pairs)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    wanted, pairs = expected([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    found = {r.vec_id: r for r in op9_embeddings(spark, SF).collect()}
    assert set(found) == set(wanted)
    links = sum(r.n_links for r in found.values()) / 2
    assert 0.99 * pairs <= links <= pairs
    assert all(found[i].n_links <= n for i, (n, _) in wanted.items())
    assert np.mean([found[i].component_id == c for i, (_, c) in wanted.items()]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_pairs_at_the_edge_and_a_large_group(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((150, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    at = 0.9505 * base + np.sqrt(1 - 0.9505**2) * side
    below = 0.9495 * base - np.sqrt(1 - 0.9495**2) * side
    hot = rng.standard_normal(32) + 0.02 * rng.standard_normal((900, 32))
    matrix = np.concatenate([base, at, below, hot, hot[:50]])
    ids = list(range(len(matrix)))
    frame = spark.createDataFrame([(i, m.tolist()) for i, m in zip(ids, matrix)], "vec_id long, embedding array<double>")
    wanted, pairs = expected(ids, matrix)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame.repartition(4)).collect()}
    assert pairs >= sum(n for n, _ in found.values()) / 2 >= 0.99 * pairs
    hot_ids = ids[450:]
    assert [found[i] for i in hot_ids] == [wanted[i] for i in hot_ids]
    assert sum(found[i][0] for i in range(150)) >= 0.97 * 150


def test_bad_vectors_link_with_nothing(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 2), (4, [], 2), (5, [0.0, 0.0], 2), (6, [1.0, None], 2),
            (7, [nan, 1.0], 2), (8, [float("inf"), 0.0], 2), (9, [1.0, 0.0, 0.0], 3), (None, [1.0, 0.0], 4), (2, [2.0, 0.0], 5),
            (10, [1e-300, 0.0], 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cap int")
    found = near_vectors(frame).groupBy("vec_id").agg(F.max("n_links"), F.max("component_id"), F.count("*")).collect()
    by = {r[0]: tuple(r)[1:] for r in found}
    assert by[1] == (4, 1, 1) and by[2] == (4, 1, 2) and by[None] == (4, 1, 1) and by[10] == (4, 1, 1)
    assert all(by[i] == (0, i, 1) for i in (3, 4, 5, 6, 7, 8, 9))


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
