"""Embeddings that nearly agree, found by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.components import components
from harborline.session import stage

MIN_COSINE = 0.95
#: Parts of a vector with a code of their own; a filter direction is one codeword of each.
CODE_PARTS = 3
#: Vectors per filter direction, so that buckets stay the same at any size of the table.
VECTORS_PER_FILTER = 2
#: Filters that a pair at the smallest cosine shares on average; e to the minus this is about what is missed.
SHARED_FILTERS = 8.0
#: A bucket's vectors are compared in tiles of about this many rows a side.
TILE_ROWS = 512
SEED = 9


def cap(filters: int, cosine: float = MIN_COSINE, shared: float = SHARED_FILTERS) -> tuple[float, float]:
    """Height of the caps in standard deviations of a score, and filters per vector at that height.

    Both follow from the number of directions: a pair at ``cosine`` must share ``shared`` on average.
    """
    normal, spread = NormalDist(), sqrt(1 - cosine * cosine)
    height, each = 0.0, 0.5 * filters
    for _ in range(40):
        share = min(each / filters, 0.5)
        height = normal.inv_cdf(1 - share)
        steps = [height + 6 * (i + 0.5) / 400 for i in range(400)]
        density = [exp(-x * x / 2) / sqrt(2 * pi) for x in steps]
        both = sum(w * normal.cdf((cosine * x - height) / spread) for w, x in zip(density, steps))
        each = shared * sum(density) / max(both, 1e-300)
    return height, min(each, 0.5 * filters)


@lru_cache(maxsize=8)
def codebook(dim: int, words: int, parts: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and per part its random unit codewords (columns)."""
    made = np.random.default_rng([seed, dim, words])
    rotation = np.linalg.qr(made.standard_normal((dim, dim)))[0]
    codes = []
    for block in np.array_split(np.arange(dim), parts):
        code = made.standard_normal((len(block), words))
        codes.append(code / np.linalg.norm(code, axis=0) * sqrt(len(block) / dim))
    return rotation, codes


def decode(units: np.ndarray, words: int, height: float, fewest: int, parts: int = CODE_PARTS, seed: int = SEED):
    """Rows and filters of all directions whose score reaches the cap, for unit vectors ``units``.

    A direction's score is the sum of one codeword's score per part, so the list is found part by
    part, dropping what cannot reach the cap with the best of the parts to come.  Vectors in fewer
    than ``fewest`` caps get lower ones, down in equal steps.
    """
    dim = units.shape[1]
    parts = min(parts, dim)
    rotation, codes = codebook(dim, words, parts, seed)
    turned = units @ rotation
    blocks = np.array_split(np.arange(dim), parts)
    scores = [turned[:, b] @ c * sqrt(dim) for b, c in zip(blocks, codes)]
    best = [s.max(axis=1) for s in scores]
    ahead = [sum(best[k + 1 :], np.zeros(len(units))) for k in range(parts)]
    rows_out, filters_out = [], []
    todo, low = np.arange(len(units)), height
    while len(todo):
        rows, filters, sums = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
        for k in range(parts):
            total = sums[:, None] + scores[k][rows]
            at, word = np.nonzero(total >= low - ahead[k][rows][:, None])
            rows, filters, sums = rows[at], filters[at] * words + word, total[at, word]
        few = np.bincount(rows, minlength=len(units)) < min(fewest, words**parts)
        done = ~few[rows]
        rows_out.append(rows[done])
        filters_out.append(filters[done])
        todo = todo[few[todo]]
        low -= 0.25
    return np.concatenate(rows_out or [np.empty(0, int)]), np.concatenate(filters_out or [np.empty(0, int)])


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow on the way."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _in_caps(nodes: DataFrame, words: int, height: float, fewest: int) -> DataFrame:
    """One row per vector and cap: ``dim``, ``cap``, ``node``, ``copies``, ``embedding``, and the vector's ``caps``."""
    names = ["dim", "cap", "node", "copies", "embedding", "caps"]
    kind = nodes.schema["embedding"].dataType.simpleString()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = part.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                rows_of = part.take(pa.array(np.flatnonzero(lengths == dim)))
                for start in range(0, len(rows_of), 1024):
                    piece = rows_of.slice(start, 1024)
                    units = unit_rows(_matrix(piece.column(2)))
                    rows, caps = decode(units, words, height, fewest)
                    order = np.lexsort((caps, rows))
                    rows, caps = rows[order], caps[order]
                    lists = np.split(caps, np.cumsum(np.bincount(rows, minlength=len(piece)))[:-1])
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), dim, np.int32)), pa.array(caps),
                            *[piece.column(i).take(take) for i in range(3)],
                            pa.array(lists, pa.list_(pa.int64())).take(take),
                        ],
                        names=names,
                    )

    return nodes.select("node", "copies", "embedding").mapInArrow(
        work, f"dim int, cap long, node long, copies long, embedding {kind}, caps array<long>"
    )


def _tile_links(cap_id: int, cross: bool, side: np.ndarray, node, copies, units, caps, cosine: float):
    """Nodes with links in a tile, the smallest node each connects to there, and the vectors it links to.

    A pair counts in the smallest cap that both lie in.
    """
    near = units @ units.T >= cosine
    np.fill_diagonal(near, False)
    if cross:
        near &= side[:, None] != side[None, :]
    if not near.any():
        return None
    rows = np.repeat(np.arange(len(node)), [len(c) for c in caps])
    flat = np.concatenate(caps)
    earlier = flat < cap_id
    if earlier.any():
        known, place = np.unique(flat[earlier], return_inverse=True)
        member = np.zeros((len(node), len(known)), np.float32)
        member[rows[earlier], place] = 1
        near &= member @ member.T == 0
    links = near @ copies
    label = np.argsort(np.argsort(node))
    while True:
        low = np.minimum(label, np.where(near, label, len(node)).min(axis=1))
        if (low == label).all():
            break
        label = low
    has = np.flatnonzero(links)
    return node[has], np.sort(node)[label[has]], links[has]


def _links(tiled: DataFrame, cosine: float) -> DataFrame:
    """Tile rows, sorted by tile, to ``node``, ``other`` and ``links``."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish(group: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(group) < 2:
                return
            first = group.slice(0, 1).to_pylist()[0]
            column = lambda n: group.column(n).combine_chunks()
            found = _tile_links(
                first["cap"], first["a"] != first["b"], column("side").to_numpy(), column("node").to_numpy(),
                column("copies").to_numpy(), unit_rows(_matrix(column("embedding"))), [np.array(c.values) for c in column("caps")], cosine,
            )
            if found:
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in found], schema=schema)

        for part in parts:
            keys = np.stack([part.column(i).to_numpy() for i in range(4)], axis=1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *new.tolist(), len(keys)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                key = tuple(keys[a].tolist())
                if last is not None and key != last:
                    yield from finish(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(part.slice(a, b - a))
        if held:
            yield from finish(pa.Table.from_batches(held))

    names = ("dim", "cap", "a", "b", "side", "node", "copies", "embedding", "caps")
    return tiled.select(*names).mapInArrow(work, "node long, other long, links long")


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """Link vectors whose cosine is at least ``cosine`` and group what links connect.

    Returns per row ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (the
    smallest id reachable) and ``kept`` (whether that is its own).  Equal vectors are one node.  A
    vector goes into the buckets of all caps it lies in; what shares a bucket is compared exactly in
    double precision.  A large bucket is compared in tiles, each a group of its own.  No link is
    below the cosine; nearly all at it and above are found (see ``SHARED_FILTERS``).

    Vectors that are null, empty, zero or have null or non-finite components link with nothing, as do
    vectors of different length.  Repeated ids are separate rows; a null id is passed over as the
    smallest unless there is no other.  Other columns are ignored; an empty table gives no rows.
    """
    good = (
        "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select("vec_id", "embedding", F.coalesce(F.expr(good), F.lit(False)).alias("good"))
    usable = rows.where("good")
    nodes = stage(
        usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "cap-nodes",
    )
    words = max(2, round((nodes.count() / VECTORS_PER_FILTER) ** (1 / CODE_PARTS)))
    height, each = cap(words**CODE_PARTS, cosine)
    in_caps = stage(_in_caps(nodes, words, height, max(1, round(each / 2))), "cap-members")
    sizes = in_caps.groupBy("dim", "cap").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    # only large buckets are listed; written, so that Spark knows the size of the list
    large = stage(sizes.where(F.col("n") > TILE_ROWS).select("dim", "cap", cuts.alias("cuts")), "cap-large")
    side = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    tiled = (
        in_caps.join(large, ["dim", "cap"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))
    )
    tile = ["dim", "cap", "a", "b"]
    found = stage(_links(tiled.repartition(*tile).sortWithinPartitions(*tile), cosine), "cap-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.join(links, "node", "left").join(roots, "node", "left")
        .select("embedding", "first", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("root", "node").alias("root"))
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    results = placed.join(firsts, "root").select("embedding", "n_links", "component_id", F.lit(True).alias("good"))
    out = rows.join(results, ["embedding", "good"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
