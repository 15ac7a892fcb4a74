import random

import pytest
from pyspark.sql import functions as F

from harborline.llm.queries import op5_repeats
from harborline.llm.repeats import find_repeats
from tests.conftest import SF
from tests.llm import brute


def digest(found):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = found.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def test_whole_table_equals_plain_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute.repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in op5_repeats(spark, SF).collect()} == expected


@pytest.mark.parametrize("seed", range(3))
def test_shifted_partial_and_periodic_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(n) for n in (40, 99, 100, 101, 180, 420)]
    texts = [None, "", "x" * 1000, "ab" * 300, word(90)]
    texts += ["".join(rng.choice([*shared, word(rng.randrange(60))]) for _ in range(rng.randrange(1, 7))) for _ in range(45)]
    for t in [t for t in texts if t][:20]:
        cut = rng.randrange(len(t))
        texts.append(t[:cut] + rng.choice(["", "!", word(30)]) + t[cut + rng.randrange(2) :])
    rows = list(enumerate(texts))
    expected = brute.repeats(rows)
    rng.shuffle(rows)
    assert digest(find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=150))
    rows = [(1, text, 5), (1, text, 6), (None, text, 7), (2, None, 8)]
    found = find_repeats(spark.createDataFrame(rows, "doc_id long, text string, place int")).collect()
    by = sorted((r.doc_id is None, r.doc_id or 0, len(r.kept)) for r in found)
    assert by == [(False, 1, 150), (False, 1, 150), (False, 2, 0), (True, 0, 0)]


def test_many_texts_without_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = [word(n) for n in (120, 150, 300)]
    texts = [word(rng.randrange(200)) + rng.choice(shared) + word(rng.randrange(400)) for _ in range(1500)]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    order = sorted((r[0], r[1]) for r in frame.select(F.xxhash64("text"), "text").collect())
    expected = brute.repeats([(i, t) for i, (_, t) in enumerate(order)])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = find_repeats(frame).select("n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found)) == sorted(expected.values())


def test_empty_table(spark):
    assert find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
