import pytest

from harborline.llm.mixing import mix_sources
from tests.llm import brute

KIND = "doc_id long, text string, source string"


def plain(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.WORDS.findall(text or ""))
    return sizes, brute.targets(sizes) if sum(sizes.values()) else {s: 0.0 for s in sizes}


@pytest.mark.parametrize("big", [1, 40, 2000])
def test_targets_and_budgets(spark, big):
    rows = [(i, "w " * (1 + i % 5) + " ", "abcdefghij"[i % 10]) for i in range(200)]
    rows += [(1000 + i, "one two  three\tfour", "d") for i in range(big)] + [(5000, None, None), (5001, "", None), (5002, "x y", None)]
    rows += [(7, "same same", "a")] * 3 + [(None, "no id", "b"), (None, None, "zz")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], f"{KIND}, size int").repartition(5)
    found = mix_sources(frame).collect()
    sizes, targets = plain(rows)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: int(t + 0.5) for s, t in targets.items()}
    again = mix_sources(frame.repartition(2)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_empty_and_wordless_tables(spark):
    assert mix_sources(spark.createDataFrame([], KIND)).count() == 0
    rows = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], KIND)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
