import numpy as np

from harborline.llm import contamination
from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shingles(tokens, n):
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def expected(docs, items):
    out = set()
    for d, text in docs:
        tokens = contamination.words(text)
        for i, item in items:
            own = contamination.words(item)
            if own:
                n = min(5, len(own))
                wanted = shingles(own, n)
                common = len(wanted & shingles(tokens, n))
                if common >= brute.need(len(wanted)):
                    out.add((d, i, len(wanted), common))
    return out


def test_partial_short_and_nested_items(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate([1, 3, 5, 6, 9, 14, 20, 40, 80, 200])] + [(50, None), (51, " .,! "), (52, "w1 w2"), (0, say(12))]
    docs = [(0, None), (1, ""), (2, say(3000))]
    for k, (_, text) in enumerate(items):
        tokens = (text or "").split()
        for cut in (0, 1, 2, 4, 8):
            docs.append((len(docs), f"{say(30)} {' '.join(tokens[cut:]).upper() if k % 2 else ', '.join(tokens[cut:])}. {say(400)}"))
            docs.append((len(docs), say(20) + " " + " ".join(tokens[: len(tokens) - cut]) + " " + say(5)))
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], f"{DOCS}, item_id string").repartition(3)
    found = contamination.contained_items(frame, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found} == expected(docs, items)
    assert all(r.containment == r.n_shared / r.n_shingles for r in found)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 60)
    items = [(i, f"item number {i} has these eight words") for i in range(8)]
    docs = [(i, f"before {t} after") for i, t in items]
    found = contamination.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(8)]


def test_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], ITEMS)
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (1, "clean"), (2, None), (None, "fine"), (3, "one two three")], DOCS)
    kept = contamination.without_contaminated(docs, items).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, "fine"), (1, "clean"), (2, ""), (3, "one two three")]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f")], DOCS)
    assert contamination.contained_items(none, spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
    assert contamination.contained_items(some, spark.createDataFrame([], ITEMS)).count() == 0


def test_clashing_names_and_small_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x", 2), (2, "z", "y", 3)], "doc_id smallint, text string, text_hash string, __hash int")
    items = spark.createDataFrame([(7, "b c d e f"), (8, "q r s t u")], "item_id smallint, text string")
    found = contamination.contained_items(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]
    kept = contamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "z", "y", 3)]
