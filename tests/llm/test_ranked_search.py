"""Ranked search against a plain scan of all documents, with small shards and blocks."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from harborline.llm import ranked_search
from harborline.session import literal_table
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(s for *_, s in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c, size in counts:
            m = 50 + (50 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_benchmark_equals_a_plain_scan(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = rows_of(ranked_search.search(docs, items))
    assert found == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


ODD = [
    (1, "a b c"), (1, "a b c"), (1, "a a a"), (None, "b c"), (None, "b c"), (None, None), (7, ""), (8, "  ,. "), (9, "A b\x00C é É ß"),
    (10, "x " * 70_000 + "needle " + "y" * 5000), (11, "needle"), (12, "é" * 10), *[(100 + i, "tie word") for i in range(200)],
]
ASKED = [(1, "a c"), (1, "a c"), (2, None), (3, ""), (4, "unknown"), (5, "needle É"), (None, "tie B"), (6, "word tie word")]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    docs = literal_table(spark, [(*r, "z", 1) for r in ODD], "doc_id bigint, text string, term string, shard int").repartition(3)
    items = literal_table(spark, [(*r, 0) for r in ASKED], "item_id bigint, text string, weight int")
    if small:
        monkeypatch.setattr(ranked_search, "GROUP_ITEMS", 2)
    assert rows_of(ranked_search.search(docs, items)) == plain(ODD, ASKED)
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_string_ids(spark):
    docs = literal_table(spark, [("b", "x y"), ("a", "x y"), (None, "x"), ("c", "z")], "doc_id string, text string")
    items = literal_table(spark, [(1, "y")], "item_id smallint, text string")
    assert [(r.rank, r.doc_id) for r in ranked_search.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_pieces_cut_long_texts_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 16)
    texts = ["ab cd " * 9, "", None, "q" * 50 + " é", "z"]
    found = []
    for start, data, offsets in ranked_search._pieces(pa.array(texts, pa.string())):
        words, rows = ranked_search._terms(data, offsets)
        found += [(start + int(r), w) for r, w in zip(rows, words.to_pylist())]
    assert found == [(i, t) for i, text in enumerate(texts) for t in terms(text)]


@pytest.mark.parametrize("seed", range(6))
def test_best_documents_equal_a_full_scan(seed):
    """Skewed lists, so that most are not essential and blocks are skipped."""
    import numpy as np

    draw, size = random.Random(seed), 3000
    lists, full = [], np.zeros(size, np.int64)
    for _ in range(draw.randint(1, 12)):
        docs = np.array(sorted(draw.sample(range(size), draw.choice([1, 5, 64, 65, 900, 2500]))))
        gains = np.array([draw.choice([1, 2, 3, draw.randint(1, 900_000)]) for _ in docs])
        weight = draw.choice([1, 40, 9000])
        heads = np.arange(0, len(docs), ranked_search.BLOCK_POSTINGS)
        gaps = np.diff(docs, prepend=0)
        gaps[heads] = 0
        raw, places = ranked_search._varints(np.stack([gaps, gains], axis=1).ravel())
        ends = np.append(heads[1:], len(docs)) - 1
        lists.append(ranked_search.Postings(weight, docs[heads], docs[ends], places[2 * heads], np.maximum.reduceat(gains, heads), raw))
        full[docs] += gains * weight
    docs, scores = ranked_search.best_documents(lists, 50)
    order = np.lexsort((np.arange(size), -full))[:50]
    order = order[full[order] > 0]
    assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
