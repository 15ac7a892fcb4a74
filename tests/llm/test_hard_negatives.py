"""Hard negatives against all products, with small shards so that trees, windows and merges all work."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import hard_negatives
from harborline.session import literal_table

KINDS = "vec_id bigint, label int, embedding array<double>, score int"


def plain(rows, anchor, k=5):
    ready = []
    for place, (vec_id, label, vector) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ready.append((place, vec_id, label, [math.floor(256 * x) for x in vector]))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
    out = []
    for place, vec_id, label, vector in ready:
        if not anchor(vec_id):
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), i, l) for p, i, l, v in ready if p != place]
        for score, positive, _ in first([s for s in scored if s[2] == label]):
            fits = first([s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score])
            out += [(vec_id, positive, r + 1, n, score, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def found(spark, rows, condition, **conf):
    made = literal_table(spark, [(*r, 1) for r in rows], KINDS).repartition(3)
    return sorted((tuple(r) for r in hard_negatives.mine(made, condition).collect()), key=str)


def clustered(n, dim, seed, labels=4):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(6, dim))
    x = centers[draw.integers(0, 6, n)] + 0.05 * draw.normal(size=(n, dim)) * draw.uniform(0.2, 4, (n, 1))
    return [(i, int(draw.integers(0, labels)), [float(v) for v in x[i]]) for i in range(n)]


@pytest.mark.parametrize("seed,dim", [(1, 3), (2, 16), (3, 64)])
def test_equals_all_products(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 170)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 9)
    rows = clustered(900, dim, seed)
    assert found(spark, rows, F.col("vec_id") % 30 == 0) == plain(rows, lambda i: i % 30 == 0)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 8)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (None, 2, [0.9, 0.1]), (None, 1, [0.95, 0.0]), (3, None, [1.0, 0.0]),
        (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 0.0]), (7, 2, [None, 1.0]), (8, 2, []), (9, 1, []), (10, 2, [0.0, 0.0]),
        (11, 1, [-1.0]), (12, 3, [0.85, 0.0, 5.0]), (12, 3, [0.85, 0.0, 5.0]), (13, 3, [1e300, 0.0]), *[(50, 2, [0.9, 0.0])] * 20,
    ]
    pick = (F.col("vec_id") < 3) | (F.col("vec_id") == 12)
    expected = plain(rows[:-21] + rows[-20:], lambda i: i is not None and (i < 3 or i == 12))
    assert found(spark, rows[:-21] + rows[-20:], pick) == expected
    huge = [(1, 1, [1e300]), (2, 1, [1e300]), (3, 2, [1e300])]
    assert [r[5] for r in found(spark, huge, F.col("vec_id") == 1)] == [2**63 - 1]
    assert found(spark, rows, F.col("vec_id") < 0) == []
    empty = literal_table(spark, [], KINDS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_tree_covers_and_bounds():
    draw = np.random.default_rng(5)
    x = np.floor(256 * draw.normal(size=(700, 8))).astype(np.int64)
    x[300:400] = x[0]
    tree = hard_negatives.CoverTree(x)
    held = np.sort(np.concatenate([n.members for n in tree.nodes if n.members is not None]))
    assert held.tolist() == list(range(700))
    queries = np.floor(256 * draw.normal(size=(20, 8))).astype(np.int64)
    least, most = tree.bounds(queries)
    products = hard_negatives.inner_products(queries, x)

    def rows(place):
        node = tree.nodes[place]
        return node.members if node.members is not None else np.concatenate([rows(c) for c in node.children])

    for place in range(len(tree.nodes)):
        inside = products[:, rows(place)]
        assert (inside.min(axis=1) >= least[:, place]).all() and (inside.max(axis=1) <= most[:, place]).all()
