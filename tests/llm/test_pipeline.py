import pytest

import __spark_entry__ as entry
import corpus_pipeline
from harborline.llm.queries import LLM_ORACLES, LLM_QUERIES
from harborline.session import stage
from tests.conftest import SF
from tests.llm import brute
from tests.oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, name):
    assert compare(LLM_QUERIES[name](spark, SF), connect(SF), LLM_ORACLES[name]) == []


def test_all_are_registered():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


def test_stages_take_effect_and_make_up_the_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, before, SF), name)
        assert after.columns == docs.columns
        seen.append((name, before, after))
        before = after
    (_, raw, known), (_, _, lines), (_, _, single), (_, _, clean) = seen
    assert 0.98 * raw.count() <= known.count() <= raw.count()
    assert lines.count() == known.count() and lines.agg({"n_chars": "sum"}).first()[0] <= known.agg({"n_chars": "sum"}).first()[0]
    given = lines.orderBy("doc_id").collect()
    root = brute.smallest_reachable(len(given), brute.near_pairs([r.text for r in given]))
    assert {r.doc_id for r in single.collect()} == {given[i].doc_id for i in range(len(given)) if root[i] == i}
    held = {r.doc_id for r in LLM_QUERIES["op6_benchmark_decontamination"](spark, SF).collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert kept <= {r.doc_id for r in single.collect()} and not kept & held
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == kept
    sizes = {}
    for r in final:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute.targets(sizes)
    for s, t in targets.items():
        assert sum(r.taken for r in final if r.source == s) == int(t + 0.5)
