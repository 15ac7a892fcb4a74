import random

import numpy as np
import pytest

from harborline.llm import simhash
from harborline.llm.queries import op7_simhash
from tests.conftest import SF
from tests.llm import brute

KIND = "doc_id long, text string"


def keep_one(docs):
    return simhash.keep_firsts(docs, simhash.near_duplicates(docs))


def expected(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: r for r, i in enumerate(order)}
    pairs = [(rank[i], rank[j]) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = brute.smallest_reachable(len(rows), pairs)
    return {rows[i][0]: (f"{prints[i]:016x}", rows[order[root[rank[i]]]][0]) for i in range(len(rows))}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash(spark, SF).collect()} == expected(rows)


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one", "a b", "A  B", "a b c", "É é x", "a b c", "a b c a b c a b c", "\x0bx\x0c"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], f"{KIND}, root int, fingerprint string")
    found = simhash.near_duplicates(frame).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected(rows)


@pytest.mark.parametrize("lanes", [2, 64, 65, 200])
def test_bit_sliced_comparison(lanes):
    rng = np.random.default_rng(lanes)
    values = rng.integers(0, 1 << 63, lanes).astype(np.uint64)
    for i in range(0, lanes - 1, 3):
        values[i + 1] = values[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)))
    near = np.array([[(int(a) ^ int(b)).bit_count() <= 2 for b in values] for a in values])
    assert (simhash.linked(values) == near).all()


@pytest.mark.parametrize("block", [2048, 8])
def test_links_of_large_buckets_are_whole(spark, monkeypatch, block):
    """The way for buckets above the block size finds what the plain way finds."""
    monkeypatch.setattr(simhash, "BLOCK_LANES", block)
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << k for k in rng.sample(range(20), rng.randrange(5))) for b in base for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.link_values(spark.createDataFrame([(v,) for v in signed], "v long")).collect()
    order = sorted(signed)
    rank = {v: i for i, v in enumerate(order)}
    pairs = [(rank[r.a], rank[r.b]) for r in found]
    wanted = [(i, j) for i in range(len(order)) for j in range(i) if ((order[i] ^ order[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    assert brute.smallest_reachable(len(order), pairs) == brute.smallest_reachable(len(order), wanted)


def test_one_of_each_group_stays(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (9, "another text with other words in it", "d"), (None, "x y z w", None)]
    kept = keep_one(spark.createDataFrame(rows, f"{KIND}, source string")).collect()
    assert sorted((r.doc_id or 0, r.source or "") for r in kept) == [(0, ""), (3, "b"), (9, "d")]


def test_texts_under_one_id_stay_beside_a_repeated_row(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue", "x y z w v u"]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (7, texts[2], "c"), (7, texts[3], "d"), (None, texts[0], "a")]
    kept = keep_one(spark.createDataFrame(rows, f"{KIND}, source string")).collect()
    assert sorted(r.source for r in kept) == ["a", "b", "c", "d"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert simhash.near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0
