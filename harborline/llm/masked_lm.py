"""Masked pseudo-likelihood of texts under a bidirectional window network trained on the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborline.llm.contamination import word_hashes
from harborline.llm.textio import byte_chunks
from harborline.session import stage

#: The network sees words in this many buckets of their hash.
BUCKETS = 1 << 16
#: Its outputs are classes of words, which stand in clusters; the most frequent buckets have a class each, the rest share classes.
CLUSTERS, CLUSTER_WORDS = 32, 64
SHARED_WORDS = 512
WORDS = CLUSTERS * CLUSTER_WORDS
PAD = WORDS
#: The most frequent words go to every task with their share of their class; all others are looked up in the counted vocabulary.
KNOWN_WORDS = 1 << 16
#: Log-shares are whole multiples of one over this, so that sums do not depend on their order.
SHARE_UNIT = 1 << 32
#: Words that a task counts before it sends what it has.
COUNT_WORDS = 1 << 21
#: Neighbours that predict a word, left and right.
WINDOW = (-2, -1, 1, 2)
HIDDEN = 32
#: In each round every MASK_EVERY-th word is masked and learnt from, others each round; the rounds mask every word once.
ROUNDS, MASK_EVERY, BATCH, RATE = 2, 2, 8192, 0.1
#: Parameters in one row on their way to the average.
BLOCK = 2048
SEED = 4


@dataclass
class Weights:
    """Embeddings per neighbour, hidden bias, cluster layer, word layer of each cluster."""

    near: np.ndarray
    hidden: np.ndarray
    cluster: np.ndarray
    cluster_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def like(cls, values: np.ndarray) -> Weights:
        shapes = (
            (len(WINDOW), WORDS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLUSTERS), (CLUSTERS,), (CLUSTERS, HIDDEN, CLUSTER_WORDS),
            (CLUSTERS, CLUSTER_WORDS),
        )
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*[v.reshape(s).copy() for v, s in zip(np.split(values.astype(np.float32), ends[:-1]), shapes)])


@dataclass
class Model:
    """``word_of`` maps hash buckets to classes; ``known`` and ``shares`` are the most frequent words and their log-shares.

    ``vocabulary`` is the stored table of all words: ``hash``, ``n`` and ``share``, the logarithm of the word's part in its
    class in ``SHARE_UNIT``.  It grows with the corpus and stays a table.
    """

    word_of: np.ndarray
    weights: Weights
    known: np.ndarray
    shares: np.ndarray
    vocabulary: DataFrame | None = None

    def local(self) -> Model:
        """What tasks need: all but the table."""
        return Model(self.word_of, self.weights, self.known, self.shares)


def count_words(docs: DataFrame) -> DataFrame:
    """``hash`` and number of every word of all texts, summed in each task first."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], schema=schema)

        for part in parts:
            for _, _, data, offsets in byte_chunks(part.column(0), 1 << 17):
                hashes, _ = word_hashes(data, offsets)
                held.append(hashes)
                size += len(hashes)
                if size >= COUNT_WORDS:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    return docs.select("text").mapInArrow(work, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def bucket_counts(counted: DataFrame) -> np.ndarray:
    """Counts by hash bucket: at most BUCKETS rows."""
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def _bucket() -> Column:
    return F.col("hash").bitwiseAND(F.lit(BUCKETS - 1))


def vocabulary(docs: DataFrame) -> Model:
    """The counted vocabulary with each word's share of its class, and the network before training."""
    counted = stage(count_words(docs), "lm-counts")
    counts = bucket_counts(counted)
    classes, weights = start(counts)
    totals = np.bincount(classes, weights=counts, minlength=WORDS)
    of_bucket = counted.sparkSession.createDataFrame(
        pa.table({"bucket": np.arange(BUCKETS), "total": totals[classes].astype(np.int64)})  # of fixed size
    )
    share = F.round(F.log(F.col("n") / F.col("total")) * SHARE_UNIT).cast("long")
    words = counted.withColumn("bucket", _bucket()).join(of_bucket, "bucket").select("hash", "n", share.alias("share"))
    words = stage(words, "lm-vocabulary")
    top = words.orderBy(F.col("n").desc(), "hash").limit(KNOWN_WORDS).select("hash", "share").toArrow()
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Model(classes, weights, hashes[order], top.column("share").to_numpy()[order], words)


def start(counts: np.ndarray) -> tuple[np.ndarray, Weights]:
    """Classes of buckets by frequency, and weights that predict the plain frequencies of classes."""
    order = np.argsort(-counts, kind="stable")
    word_of = np.empty(BUCKETS, np.int32)
    own = WORDS - SHARED_WORDS
    word_of[order[:own]] = np.arange(own)
    word_of[order[own:]] = own + order[own:] % SHARED_WORDS
    words = np.bincount(word_of, weights=counts, minlength=WORDS).reshape(CLUSTERS, CLUSTER_WORDS) + 1.0
    made = np.random.default_rng(SEED)
    draw = lambda *shape: (made.standard_normal(shape) * 0.1).astype(np.float32)
    return word_of, Weights(
        draw(len(WINDOW), WORDS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, CLUSTERS),
        np.log(words.sum(1)).astype(np.float32), draw(CLUSTERS, HIDDEN, CLUSTER_WORDS), np.log(words).astype(np.float32),
    )


def neighbours(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The word numbers at the window's places, a column per place; outside the text ``PAD``."""
    out = np.full((len(words), len(WINDOW)), PAD, np.int32)
    n = len(words)
    for k, step in enumerate(WINDOW):
        here = slice(max(0, -step), min(n, n - step))
        there = slice(max(0, step), min(n, n + step))
        if here.start < here.stop:
            out[here, k] = np.where(rows[here] == rows[there], words[there], PAD)
    return out


def _by_cluster(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by cluster, and where each cluster begins in it.  Short numbers are sorted by counting."""
    cluster = (words // CLUSTER_WORDS).astype(np.int16)
    order = np.argsort(cluster, kind="stable")
    return order, np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at one column of each row."""
    logits -= logits.max(axis=1, keepdims=True)
    at = logits[np.arange(len(logits)), chosen]
    return at - np.log(np.exp(logits, out=logits).sum(axis=1))


def _hidden(w: Weights, around: np.ndarray) -> np.ndarray:
    total = w.near[0][around[:, 0]]
    for k in range(1, len(WINDOW)):
        total += w.near[k][around[:, k]]
    total += w.hidden
    return np.tanh(total, out=total)


def log_probabilities(w: Weights, words: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word's class given the words around it."""
    order, ends = _by_cluster(words)
    words, hidden = words[order], _hidden(w, around[order])
    logs = _log_chosen(hidden @ w.cluster + w.cluster_bias, words // CLUSTER_WORDS).astype(np.float64)
    place = words % CLUSTER_WORDS
    for c in range(CLUSTERS):
        a, b = ends[c], ends[c + 1]
        if a < b:
            logs[a:b] += _log_chosen(hidden[a:b] @ w.word[c] + w.word_bias[c], place[a:b])
    out = np.empty(len(words))
    out[order] = logs
    return out


def learn_batch(w: Weights, past: Weights, words: np.ndarray, around: np.ndarray) -> None:
    """One step on masked ``words``, with step lengths by the sums ``past`` of squared gradients."""
    n = len(words)
    order, ends = _by_cluster(words)
    words, around = words[order], around[order]
    hidden = _hidden(w, around)
    index, place = np.arange(n), words % CLUSTER_WORDS
    error = _softmax(hidden @ w.cluster + w.cluster_bias)
    error[index, words // CLUSTER_WORDS] -= 1
    error /= n
    back = error @ w.cluster.T
    gradient, bias = np.zeros_like(w.word), np.zeros_like(w.word_bias)
    for c in range(CLUSTERS):
        a, b = ends[c], ends[c + 1]
        if a == b:
            continue
        wrong = _softmax(hidden[a:b] @ w.word[c] + w.word_bias[c])
        wrong[index[: b - a], place[a:b]] -= 1
        wrong /= n
        back[a:b] += wrong @ w.word[c].T
        np.matmul(hidden[a:b].T, wrong, out=gradient[c])
        bias[c] = wrong.sum(0)

    def move(name: str, step: np.ndarray) -> None:
        square = getattr(past, name)
        square += step * step
        getattr(w, name)[...] -= RATE * step / np.sqrt(square + 1e-10)

    move("word", gradient)
    move("word_bias", bias)
    move("cluster", hidden.T @ error)
    move("cluster_bias", error.sum(0))
    back *= 1 - hidden * hidden
    move("hidden", back.sum(0))
    for k in range(len(WINDOW)):
        column = around[:, k].astype(np.int16)
        order = np.argsort(column, kind="stable")
        first = np.flatnonzero(np.diff(column[order], prepend=-1))
        step = np.add.reduceat(back[order], first, axis=0)
        rows = column[order[first]]
        square = past.near[k][rows] + step * step
        past.near[k][rows] = square
        w.near[k][rows] -= RATE * step / np.sqrt(square + 1e-10)


def _words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, rows and hashes of the words of a run of texts."""
    hashes, rows = word_hashes(data, offsets)
    return model.word_of[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)], rows, hashes


def _round(docs: DataFrame, model: Model, turn: int) -> Weights:
    """One pass over all texts: each task learns on its own from the same weights, then weights are averaged.

    Tasks send their weights in blocks, weighted by words learnt from; blocks are summed in groups of
    tasks and then in total, so that no task sees more than about the root of their number.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.local())  # of fixed size
    schema = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("n", pa.float64()), ("sums", pa.list_(pa.float64()))])
    kind = "block int, task int, n double, sums array<double>"

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        w = Weights.like(known.weights.flat())
        past = Weights.like(np.zeros_like(known.weights.flat()))
        learnt, held_words, held_around, held = 0, [], [], 0
        for part in parts:
            for _, _, data, offsets in byte_chunks(part.column(0), 1 << 17):
                words, rows, _ = _words(known, data, offsets)
                at = np.arange(turn * MASK_EVERY // ROUNDS, len(words), MASK_EVERY)
                held_words.append(words[at])
                held_around.append(neighbours(words, rows)[at])
                held += len(at)
                if held >= BATCH:
                    words, around = np.concatenate(held_words), np.concatenate(held_around)
                    for i in range(0, held - held % BATCH, BATCH):
                        learn_batch(w, past, words[i : i + BATCH], around[i : i + BATCH])
                    learnt += held - held % BATCH
                    held_words, held_around = [words[held - held % BATCH :]], [around[held - held % BATCH :]]
                    held %= BATCH
        if held:
            learn_batch(w, past, np.concatenate(held_words), np.concatenate(held_around))
            learnt += held
        if learnt:
            task = TaskContext.get().partitionId()
            values = w.flat().astype(np.float64) * learnt
            blocks = np.split(values, np.arange(BLOCK, len(values), BLOCK))
            count = len(blocks)
            yield pa.record_batch(
                [pa.array(np.arange(count, dtype=np.int32)), pa.array(np.full(count, task, np.int32)),
                 pa.array(np.full(count, float(learnt))), pa.array(blocks, pa.list_(pa.float64()))],
                schema=schema,
            )

    def total(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        rows = np.array(group.column("sums").combine_chunks().flatten()).reshape(len(group), -1)
        one = [group.column("block")[0].as_py()], [group.column("task")[0].as_py()], [sum(group.column("n").to_pylist())], [rows.sum(0)]
        return pa.table([pa.array(v, f.type) for v, f in zip(one, schema)], schema=schema)

    texts = docs.select("text")
    groups = max(1, ceil(sqrt(texts.rdd.getNumPartitions())))
    sent = texts.mapInArrow(work, kind)
    some = sent.groupBy("block", F.col("task") % groups).applyInArrow(total, kind)
    whole = some.groupBy("block").applyInArrow(total, kind).collect()  # the size of the model
    shared.unpersist()
    if not whole:
        return model.weights
    rows = sorted(whole, key=lambda r: r["block"])
    return Weights.like(np.concatenate([np.array(r["sums"]) / r["n"] for r in rows]))


def train(docs: DataFrame) -> Model:
    """A model of the words of all texts: their counts, then rounds of masked training over all of them.

    The result depends on how the table is cut into tasks, but not on the order in which they end.
    Null and empty texts add nothing; an empty table gives a model of equal frequencies.
    """
    model = vocabulary(docs)
    for turn in range(ROUNDS):
        model.weights = _round(docs, model, turn)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` (sum over words) and ``score`` (mean) of every row.

    Each word of the whole text is predicted from the words on both sides of it, as if masked: the
    probability of its class there times the word's share of the class in the corpus.  The most
    frequent words' shares go to every task; the rest of a text's words are joined to the vocabulary.  A
    word that the model has not counted has a share of 2 to the minus 64.

    Texts that are null or without words have likelihood zero and a null score.  Equal rows score
    equally.  Other columns are ignored.
    """
    doc_type = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model.local())  # of fixed size
    schema = pa.schema([
        ("doc_id", to_arrow_type(doc_type)), ("n_tokens", pa.int64()), ("classes", pa.float64()), ("shares", pa.int64()),
        ("rare", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))),
    ])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            counts, logs, shares, rare_sizes, rare_hashes, rare_counts = [], [], [], [], [], []
            for first, end, data, offsets in byte_chunks(part.column(1), 1 << 17):
                words, rows, hashes = _words(known, data, offsets)
                found = log_probabilities(known.weights, words, neighbours(words, rows))
                size = end - first
                counts.append(np.bincount(rows, minlength=size))
                logs.append(np.bincount(rows, weights=found, minlength=size))
                at = np.minimum(np.searchsorted(known.known, hashes), max(len(known.known) - 1, 0))
                hit = known.known[at] == hashes if len(known.known) else np.zeros(len(hashes), bool)
                total = np.zeros(size, np.int64)
                np.add.at(total, rows[hit], known.shares[at[hit]])
                shares.append(total)
                rest, owner = hashes[~hit], rows[~hit]
                order = np.lexsort((rest, owner))
                rest, owner = rest[order], owner[order]
                heads = np.flatnonzero(np.concatenate(([True], (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])))) if len(rest) else np.empty(0, np.int64)
                rare_hashes.append(rest[heads])
                rare_counts.append(np.diff(np.append(heads, len(rest))))
                rare_sizes.append(np.bincount(owner[heads], minlength=size))
            join = lambda made, kind: np.concatenate(made).astype(kind) if made else np.empty(0, kind)
            pairs = pa.StructArray.from_arrays(
                [pa.array(join(rare_hashes, np.uint64).view(np.int64)), pa.array(join(rare_counts, np.int64))], fields=list(schema.field("rare").type.value_type)
            )
            ends = np.concatenate(([0], np.cumsum(join(rare_sizes, np.int64)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(join(counts, np.int64)), pa.array(join(logs, np.float64)), pa.array(join(shares, np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pairs)],
                schema=schema,
            )

    kind = f"doc_id {doc_type.simpleString()}, n_tokens long, classes double, shares long, rare array<struct<hash:long,n:long>>"
    made = docs.select("doc_id", "text").mapInArrow(work, kind)
    numbered = stage(made.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = numbered.select("row", F.explode("rare").alias("w")).select("row", "w.hash", "w.n")
    unseen = F.lit(-round(64 * log(2) * SHARE_UNIT))
    looked = rare.join(model.vocabulary.select("hash", "share"), "hash", "left")
    sums = looked.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("share", unseen)).alias("more"))
    total = F.col("classes") + (F.col("shares") + F.coalesce("more", F.lit(0))) / F.lit(float(SHARE_UNIT))
    summed = numbered.drop("rare").join(sums, "row", "left").withColumn("log_likelihood", total)
    return summed.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("score"))
