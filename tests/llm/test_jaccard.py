import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import jaccard
from tests.conftest import SF
from tests.llm import brute


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (80, 150, 400, 900)]
    texts = [None, "", "one two", "One  two", "one three"] + [" ".join(w) for w in base]
    for words in base:
        for edits in (1, 2, 4, 8, 16, 40):
            copy = list(words)
            for place in rng.sample(range(len(copy)), edits):
                copy[place] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(None, texts[5]), (3, "One  two")]
    root = brute.smallest_reachable(len(texts), brute.near_pairs(texts))
    expected = [i for i in range(len(texts)) if root[i] == i]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, frame, SF).collect()) == expected


def loose_group(n, rng):
    """Edited copies of one text: nearly all pairs share bands, few are similar enough."""
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for place in rng.sample(range(len(copy)), rng.choice([2, 5, 6])):
            copy[place] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [jaccard.TILE_WEIGHT, 4 * jaccard.LEAST_WEIGHT])
def test_large_group_of_loose_copies(spark, monkeypatch, tile):
    """Every link counts, and links come as a forest: the rows between steps grow with the sets, not with their pairs."""
    monkeypatch.setattr(jaccard, "TILE_WEIGHT", tile)
    seen = []
    keep = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda *a: seen.append(keep(*a)) or seen[-1])
    texts = loose_group(150, random.Random(5))
    root = brute.smallest_reachable(len(texts), brute.near_pairs(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in jaccard.keep_one(frame).collect())
    assert kept == [i for i in range(len(texts)) if root[i] == i]
    tiles = -(-150 * jaccard.LEAST_WEIGHT // tile)
    assert sum(links.count() for links in seen) <= 150 * (1 + tiles)


def test_recall_on_the_documents(spark):
    """Groups equal those of all pairs at 0.8; bands may miss a pair in 300,000."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    root = brute.smallest_reachable(len(rows), brute.near_pairs([r.text for r in rows]))
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {rows[i].doc_id for i in range(len(rows)) if root[i] == i}


def test_overlaps_equal_plain_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "_COLUMNS", 7)
    draw = np.random.default_rng(2)
    x, y = ([np.unique(draw.integers(0, 60, n)) for n in draw.integers(1, 50, 9)] for _ in range(2))
    assert jaccard.overlaps(x, y).tolist() == [[len(set(a) & set(b)) for b in y] for a in x]


def test_empty_table_and_clashing_names(spark):
    kinds = "doc_id long, text string, text_hash string, TEXT_HASH_ int, root int, node int, hashes int"
    rows = [(1, "a b c d e f", "h", 1, 2, 3, 4), (2, "a b c d e f", "i", 1, 2, 3, 4), (3, "z", "j", 1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, kinds)
    assert sorted(tuple(r) for r in jaccard.keep_one(frame).collect()) == [rows[0], rows[2]]
    assert jaccard.keep_one(frame).columns == frame.columns
    assert jaccard.keep_one(frame.limit(0)).count() == 0


def test_simhash_finds_copies_that_share_no_band(spark, monkeypatch):
    """The fingerprints are a way of their own to the candidates; the exact comparison follows them too."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(1500)] for _ in range(4)]
    texts = [None, ""] + [" ".join(w) for w in base] + [" ".join(w[:-1] + ["new"]) for w in base]
    made = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda docs: made(docs).withColumn("bands", F.array().cast("array<bigint>")))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(frame).collect()) == [0, 2, 3, 4, 5]
