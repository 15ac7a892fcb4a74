"""Hard negatives by inner product: cover trees over norm-augmented candidates, searched best-first."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.prefix import prefix_sums
from harborline.session import stage

POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
LOW_PERCENT, HIGH_PERCENT = 80, 100
#: Components are scaled by this and floored.
SCALE = 256
#: Candidates of a tree, and anchors searched in it by one task.
SHARD_ROWS, GROUP_ANCHORS = 8192, 4096
#: Cells of up to this many candidates are leaves; smaller ones share leaves under their parent's center.
LEAF_ROWS = 64
#: Covering radius of a level over that of the level below.
LEVEL_RATIO = 1.5
SEED = 13

_LONG = np.iinfo(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two int64 matrices; beyond a long they are held at its ends."""
    most = _greatest(a) * _greatest(b) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    whole = np.dot(a.astype(object), b.astype(object).T).reshape(len(a), len(b))
    return np.clip(whole, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def _greatest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


@dataclass
class Node:
    """A ball of the tree: all its candidates lie within ``radius`` of ``center``."""

    center: int
    radius: float
    children: list[int] = field(default_factory=list)
    members: np.ndarray | None = None


class CoverTree:
    """Candidates of a shard, each with one more coordinate that makes all norms equal.

    With equal norms an inner product is a distance, so a ball bounds the products of all its
    candidates from above and below.  The centers of a level are candidates that lie further apart
    than its covering radius; every candidate lies in the cell of a center that covers it.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.nodes: list[Node] = []
        plain = vectors.astype(np.float64)
        self.size = max(float(np.abs(plain).max(initial=0)), 1.0)
        plain = plain / self.size
        norms = np.einsum("ij,ij->i", plain, plain)
        self.norm = float(np.sqrt(norms.max(initial=0)))
        self.points = np.column_stack([plain, np.sqrt(np.maximum(self.norm**2 - norms, 0))])
        if len(vectors):
            self._add(np.arange(len(vectors)), 0, self._far(np.arange(len(vectors)), 0))
        centers = [n.center for n in self.nodes]
        self.centers = plain[centers] if centers else plain[:0]
        self.radii = np.array([n.radius for n in self.nodes])

    def _far(self, rows: np.ndarray, center: int) -> np.ndarray:
        gap = self.points[rows] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _add(self, rows: np.ndarray, center: int, far: np.ndarray) -> int:
        """Nodes for a cell and all below it; a stack, as a tree of near copies may be deep."""
        self.nodes.append(Node(center, float(far.max())))
        todo = [(0, rows, far)]
        while todo:
            place, rows, far = todo.pop()
            node = self.nodes[place]
            if len(rows) <= LEAF_ROWS or node.radius == 0:
                node.members = np.sort(rows)
                continue
            small: list[np.ndarray] = []
            reach, head = node.radius / LEVEL_RATIO, node.center
            while len(rows):
                near = far <= reach
                near |= rows == head
                if near.sum() < LEAF_ROWS // 2:
                    small.append(rows[near])
                else:
                    node.children.append(len(self.nodes))
                    self.nodes.append(Node(head, float(far[near].max())))
                    todo.append((len(self.nodes) - 1, rows[near], far[near]))
                rows = rows[~near]
                if len(rows):
                    head = int(rows[0])
                    far = self._far(rows, head)
            if small:
                loose = np.concatenate(small)
                gaps = self._far(loose, node.center)
                order = np.argsort(gaps, kind="stable")
                for start in range(0, len(loose), LEAF_ROWS):
                    part = order[start : start + LEAF_ROWS]
                    node.children.append(len(self.nodes))
                    self.nodes.append(Node(node.center, float(gaps[part].max()), members=np.sort(loose[part])))
        return 0

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product that any candidate of each node may have with each query.

        On the sphere a ball is a cap: the angle to a candidate differs from that to the center by
        at most the cap's.  A little is added for rounding.
        """
        plain = queries.astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", plain, plain))
        most = lengths * self.norm
        cosine = np.divide(plain @ self.centers.T, most[:, None], out=np.zeros((len(plain), len(self.radii))), where=most[:, None] > 0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        width = 2 * np.arcsin(np.clip(self.radii / max(2 * self.norm, 1e-300), 0, 1)) + 1e-6
        low = most[:, None] * np.cos(np.minimum(angle + width, np.pi)) * self.size
        high = most[:, None] * np.cos(np.maximum(angle - width, 0)) * self.size
        slack = 1 + 1e-9 * most[:, None] * self.size
        end = 0.99 * float(_LONG.max)  # scores are held at the ends of a long
        return np.minimum(low - slack, end), np.maximum(high + slack, -end)


class _Best:
    """The best few candidates of a window: by falling score, then by place."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.kept: list[tuple[int, int]] = []

    def floor(self) -> float:
        """Scores below can't get in any more."""
        worst = -self.kept[-1][0] if len(self.kept) == self.k else -np.inf
        return worst if self.low is None else max(worst, self.low)

    def open(self, least: float, most: float) -> bool:
        return most >= self.floor() and (self.high is None or least <= self.high)

    def offer(self, scores: np.ndarray, places: np.ndarray) -> None:
        fits = scores >= self.floor()
        if self.high is not None:
            fits &= scores <= self.high
        if fits.any():
            self.kept = sorted(self.kept + list(zip((-scores[fits]).tolist(), places[fits].tolist())))[: self.k]


def descend(
    tree: CoverTree, query: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray], windows: list[_Best]
) -> None:
    """Fill the windows with the best candidates that ``wanted`` lets through.

    The node that may hold the highest product comes next; a node that no open window touches is
    left out with all below it, and the search ends when no window can still gain.
    """
    heap = [(-most[0], 0)]
    while heap:
        high, place = heapq.heappop(heap)
        if -high < min(w.floor() for w in windows):
            return
        if not any(w.open(least[place], -high) for w in windows):
            continue
        node = tree.nodes[place]
        if node.members is None:
            for child in node.children:
                heapq.heappush(heap, (-most[child], child))
            continue
        rows = node.members[wanted(node.members)]
        if len(rows):
            scores = inner_products(query[None, :], tree.vectors[rows])[0]
            for window in windows:
                window.offer(scores, rows)


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    held = column.combine_chunks()
    held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
    sizes = np.diff(held.offsets.to_numpy())
    values = held.values.to_numpy(zero_copy_only=False)[held.offsets[0].as_py() : held.offsets[-1].as_py()].astype(np.int64)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def _search(anchors: pa.Table, candidates: pa.Table, same_label: bool, k: int) -> pa.Table:
    """The best candidates of one shard in each window of each anchor of one group."""
    names = ["anchor", "window", "row", "vec_id", "score"]
    if not anchors.num_rows or not candidates.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    order = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last, so place breaks ties
    vectors, queries = _matrix(order.column("vector")), _matrix(anchors.column("vector"))
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, queries))
    labels, rows = order.column("label").to_pandas().to_numpy(), order.column("row").to_numpy()
    tree = CoverTree(vectors)
    least, most = tree.bounds(queries)
    ids = order.column("vec_id").to_pylist()
    out: list[list] = [[] for _ in names]
    for i, (own, label, windows) in enumerate(zip(*(anchors.column(n).to_pylist() for n in ("row", "label", "windows")))):
        # Windows are positive scores; without any, the one window is open.
        kept = [_Best(-(-LOW_PERCENT * s // 100), HIGH_PERCENT * s // 100, k) for s in windows] if windows is not None else [_Best(None, None, k)]
        if same_label:
            descend(tree, queries[i], least[i], most[i], lambda m: (labels[m] == label) & (rows[m] != own), kept)
        else:
            descend(tree, queries[i], least[i], most[i], lambda m: labels[m] != label, kept)
        for j, window in enumerate(kept):
            for score, place in window.kept:
                for column, value in zip(out, (own, windows[j] if windows is not None else 0, int(rows[place]), ids[place], -score)):
                    column.append(value)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out)})


def _found(anchors: DataFrame, candidates: DataFrame, same_label: bool, k: int) -> DataFrame:
    """Best candidates per shard; both sides have ``shard`` and ``part``, the group of anchors."""
    both = anchors.groupBy("shard", "part").cogroup(candidates.groupBy("shard", "part"))
    return both.applyInArrow(lambda a, c: _search(a, c, same_label, k), "anchor long, window long, row long, vec_id long, score long")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and whole-number ``vector`` of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of every anchor and each of its best positives.

    ``vectors`` has ``vec_id``, ``label`` (whole numbers) and ``embedding``; ``is_anchor`` is a condition on ``vec_id``
    and ``label``.  Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a shorter
    vector counts as one that ends in zeros.  Every row counts by itself, also under a repeated or
    null id: an anchor's copy is one of its positives, and two anchors of one id have rows each.
    Ties go by smaller id, nulls last.  A pair without a negative in its window gives no row, nor
    does an empty table; other columns are left out.  Scores beyond a long are held at its ends.

    Rows are numbered by label and a hash, so that a shard is a fixed number of rows of few labels
    and a label of any size is split.  Anchors meet the shards of their label for positives, and all
    shards, in groups, for negatives; shards hand over at most as many rows as are asked for.
    """
    ready = usable(vectors).withColumns({"one": F.lit(1), "hash": F.xxhash64("vec_id", "vector", F.lit(SEED))})
    placed = prefix_sums(ready, [], ["label", "hash", "vec_id"], "one", "row")
    rows = stage(
        placed.select("vec_id", "label", "vector", F.col("row").cast("long"), F.expr(f"row DIV {SHARD_ROWS}").alias("shard")), "negatives-rows"
    )
    total = rows.count()
    chosen = rows.where(is_anchor)
    shards, parts = -(-total // SHARD_ROWS), max(1, -(-chosen.count() // GROUP_ANCHORS))
    asked = chosen.select("row", "vec_id", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    renewed = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, as both sides are grouped together
    every = renewed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    of_label = rows.select("label", "shard").distinct()
    own = asked.join(of_label, "label").withColumn("windows", F.lit(None).cast("array<long>"))
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    near = _found(own, every, True, positives).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = stage(near.select("anchor", "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-pairs")

    scores = pairs.groupBy("anchor").agg(F.collect_set("positive_score").alias("windows"))
    windowed = asked.join(scores, asked["row"] == scores["anchor"]).drop("anchor")
    spread = windowed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards, 1) - 1).cast("long"))))
    inside = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    hard = _found(spread, every, False, negatives).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= negatives)
    hard = hard.select("anchor", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(hard, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
WITH ready AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM ready a JOIN ready b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT * FROM (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5
"""
