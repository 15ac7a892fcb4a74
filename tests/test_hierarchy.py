"""Pointer doubling over parents: chains, trees, cycles and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import hierarchy


def plain(pairs):
    parent = {}
    for n, p in pairs:
        if n is not None:
            known = [x for x in (parent.get(n), p) if x is not None]
            parent[n] = min(known) if known else None
    out = {}
    for n in parent:
        at, depth = n, 0
        while depth <= len(parent) and parent[at] is not None and parent[at] in parent:
            at, depth = parent[at], depth + 1
        out[n] = (at, depth) if depth <= len(parent) else (None, None)
    return out


def found(spark, pairs):
    df = spark.createDataFrame(pairs, "id bigint, up bigint").repartition(3)
    return {r["node"]: (r["root"], r["depth"]) for r in hierarchy.roots(df, "id", "up").collect()}


def test_trees_cycles_and_odd_rows(spark):
    pairs = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (None, 1), (6, 7), (7, 8), (8, 6), (9, 6), (10, 10), (3, 2), (11, 3), (11, 2)]
    assert found(spark, pairs) == plain(pairs)
    assert found(spark, []) == {} and found(spark, [(1, None)]) == {1: (1, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_and_a_hub(spark, seed):
    draw = random.Random(seed)
    pairs = [(i, draw.choice([None, draw.randrange(i)]) if i else None) for i in range(300)] + [(1000 + i, 250) for i in range(500)]
    assert found(spark, pairs) == plain(pairs)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 links in at most 15 rounds, not 10,000."""
    rounds = []
    keep = hierarchy.stage
    monkeypatch.setattr(hierarchy, "stage", lambda df, label: rounds.append(label) or keep(df, label))
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    out = hierarchy.roots(chain, "id", "up")
    assert out.where("root <> 0 OR depth <> node OR root IS NULL").isEmpty() and out.count() == 10_000
    assert len(rounds) <= 17
