import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import masked_lm as lm
from harborline.llm.contamination import word_hashes, words
from harborline.llm.queries import op4_masked_lm
from tests.conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(docs):
    return lm.train(docs)


def number(model, word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(model.word_of[int(word_hashes(data, np.array([0, len(data)]))[0][0]) % lm.BUCKETS])


@pytest.fixture(scope="module")
def counts(docs):
    return Counter(w for r in docs.collect() for w in words(r.text))


def plain_likelihood(model, counts, text):
    """Class given context by the weights, times the word's part of its class by plain counts."""
    w, ids, total = model.weights, [number(model, x) for x in words(text)], 0.0
    classes = Counter()
    for word, n in counts.items():
        classes[number(model, word)] += n
    total = sum(math.log(counts[x] / classes[c]) for x, c in zip(words(text), ids))
    for i, word in enumerate(ids):
        hidden = w.hidden.astype(float).copy()
        for k, step in enumerate(lm.WINDOW):
            hidden += w.near[k][ids[i + step] if 0 <= i + step < len(ids) else lm.PAD]
        hidden = np.tanh(hidden)
        cluster, place = divmod(word, lm.CLUSTER_WORDS)
        for logits, at in ((hidden @ w.cluster + w.cluster_bias, cluster), (hidden @ w.word[cluster] + w.word_bias[cluster], place)):
            total += logits[at] - math.log(np.exp(logits).sum())
    return total


@pytest.mark.parametrize("known", [1 << 16, 40])
def test_scores_are_the_models_conditionals(spark, docs, model, counts, known):
    """Whether shares come with the task or from the vocabulary's table."""
    model = replace(model, known=model.known[:known], shares=model.shares[:known])
    a, b = [w for w, _ in counts.most_common()][5], counts.most_common()[-1][0]
    rows = [(i, r.text) for i, r in enumerate(docs.limit(6).collect())] + [(90, a), (91, f"{a} {b}"), (92, None), (93, " .,"), (94, f"{a} {b}")]
    found = lm.score(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), model).orderBy("doc_id").collect()
    for r, (_, text) in zip(found, sorted(rows, key=lambda r: r[0])):
        n = len(words(text))
        assert r.n_tokens == n and r.log_likelihood == pytest.approx(plain_likelihood(model, counts, text) if n else 0.0, rel=1e-4)
        assert (r.score is None) if n == 0 else r.score == pytest.approx(r.log_likelihood / n)


def test_training_beats_plain_frequencies_and_order_matters(spark, docs, model):
    mean = lambda m, d: lm.score(d, m).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(model, docs) > mean(lm.vocabulary(docs), docs) + 0.1
    mixed = [(r.doc_id, " ".join(random.Random(r.doc_id).sample(words(r.text), len(words(r.text))))) for r in docs.collect()]
    assert mean(model, docs) > mean(model, spark.createDataFrame(mixed, "doc_id long, text string"))


def test_vocabulary_is_whole_and_shares_add_up(docs, model, counts):
    held = model.vocabulary.collect()
    assert len(held) == len(counts) and sum(r.n for r in held) == sum(counts.values())
    parts = Counter()
    for r in held:
        parts[int(model.word_of[r.hash % lm.BUCKETS])] += math.exp(r.share / lm.SHARE_UNIT)
    assert all(abs(p - 1) < 1e-6 for p in parts.values())
    assert len(model.known) == min(lm.KNOWN_WORDS, len(counts)) and (np.diff(model.known.astype(object)) > 0).all()


def test_words_of_a_class_are_told_apart(spark):
    """Gibberish that stands once scores below rare words that stand often, in the same places and classes."""
    rare = [f"word{i}" for i in range(4000)]
    texts = [" ".join(rare[i : i + 8]) for i in range(0, 4000, 8)] * 6 + [" ".join(f"x{i}q{k}z" for k in range(8)) for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs)).collect()}
    once, often = [found[i] for i in range(3000, 3500)], [found[i] for i in range(500)]
    assert max(once) < min(often)


def test_unseen_words_score_lowest(spark, docs, model, counts):
    rows = spark.createDataFrame([(1, "neverseenbefore1"), (2, counts.most_common()[-1][0])], "doc_id long, text string")
    found = {r.doc_id: r.log_likelihood for r in lm.score(rows, model).collect()}
    assert found[1] < found[2] - 10


def test_words_at_every_place_are_learnt(spark):
    places = [[f"p{k}" if k % 4 else f"q{k}{i % 2}" for k in range(16)] for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(places)], "doc_id long, text string").coalesce(1)
    before, after = lm.vocabulary(docs), lm.train(docs)
    words = np.array([number(after, w) for w in places[0]])
    around = lm.neighbours(words, np.zeros(16, np.int64))
    gain = lm.log_probabilities(after.weights, words, around) - lm.log_probabilities(before.weights, words, around)
    assert (gain > 0.1).all()


def test_reruns_agree(spark):
    a, b = ({r.doc_id: r.log_likelihood for r in op4_masked_lm(spark, SF).collect()} for _ in range(2))
    assert a == b


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, lm.train(empty)).count() == 0
