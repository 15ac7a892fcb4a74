"""Near-duplicates of word shingle sets: SimHash fingerprints, MinHash bands beyond their radius, exact comparison, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from harborline.llm.components import components
from harborline.llm.prefix import prefix_sums
from harborline.llm.simhash import keep_firsts, link_values, majority
from harborline.llm.textio import byte_chunks, mix64, same
from harborline.session import stage

SHINGLE_WORDS, MIN_SIMILARITY, SEED = 5, 0.8, 42
#: Sets of similarity s share no band with probability (1 - s ** BAND_ROWS) ** BANDS, 3e-6 at 0.8.
BANDS, BAND_ROWS = 32, 5
_SLICE = 1024
#: Sets are compared in tiles of about this many shingles a side; a set counts as many, and at least as LEAST_WEIGHT.
TILE_WEIGHT, LEAST_WEIGHT = 1 << 19, 512
#: Shingles of a tile that are counted at a time.
_COLUMNS = 4096
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), np.uint64).astype(np.uint32)
_FLIP, _FACTOR = _DRAWN[0], _DRAWN[1] | np.uint32(1)
_STEPS = mix64(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of one lower-cased text, ascending; short texts are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    count = max(len(words) - SHINGLE_WORDS + 1, 1)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(count)), np.uint64, count))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), _SLICE):
        np.minimum(least, ((high[i : i + _SLICE, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return mix64((least.astype(np.uint64).reshape(BANDS, BAND_ROWS) * _STEPS).sum(axis=1, dtype=np.uint64))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in byte_chunks(column):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield shingles(data[a:b].tobytes())


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (hash of the shingle set), ``size``, ``fingerprint`` and ``bands`` of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    kinds = (("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fingerprint", pa.int64()), ("bands", pa.list_(pa.int64())))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, sizes, prints, keys = [], [], [], []
            for found in _sets(part.column(2)):
                nodes.append(xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(majority(found))
                keys.append(bands(found).view(np.int64) if len(found) else [])
            columns = [part.column(0), part.column(1), np.array(nodes, np.uint64).view(np.int64), sizes, np.array(prints, np.uint64).view(np.int64), keys]
            yield pa.record_batch([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds))

    return narrow.mapInArrow(run, "doc_id long, text_hash long, node long, size long, fingerprint long, bands array<long>")


def _sets_of(nodes: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The shingle set of each of ``nodes``, as ``hashes``, from one document that has it."""
    texts = firsts.join(nodes, "node").select("node", "first.doc_id", "first.text_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    chosen = rows.join(texts, same(rows, texts, ["doc_id", "text_hash"])).select("node", "text")

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [s.view(np.int64) for s in _sets(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "hashes"])

    made = chosen.mapInArrow(hashed, "node long, hashes array<long>")
    return stage(made.groupBy("node").agg(F.first("hashes").alias("hashes")), "jaccard-sets")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``x`` shares with each of ``y``."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, values), len(common) - 1)
        shared = common[column] == values
        order = np.argsort(column[shared], kind="stable")
        return column[shared][order], rows[shared][order]

    if not len(common):
        return out.astype(np.int64)
    sides = [(len(sets), *places(sets)) for sets in (x, y)]
    for start in range(0, len(common), _COLUMNS):
        marks = []
        for count, column, row in sides:
            a, b = np.searchsorted(column, (start, start + _COLUMNS))
            mark = np.zeros((count, _COLUMNS), np.float32)
            mark[row[a:b], column[a:b] - start] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T  # whole numbers below 2 ** 24
    return out.astype(np.int64)


def _joining_links(group: pa.Table) -> pa.Table:
    """Of one pair of tiles, links between different groups that suffice to join what its links join."""
    group = group.combine_chunks().sort_by("node")
    side, nodes, groups = (group.column(n).to_numpy() for n in ("side", "node", "group"))
    column = group.column("hashes").chunk(0)
    sets = [column[i].values.to_numpy() for i in range(len(column))]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    ends: list[tuple[int, int]] = []
    if len(x):
        sizes = np.array([len(s) for s in sets])
        shared = overlaps([sets[i] for i in x], [sets[i] for i in y])
        near = shared >= MIN_SIMILARITY * (sizes[x][:, None] + sizes[y][None, :] - shared) - 1e-9
        near &= groups[x][:, None] != groups[y][None, :]
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while parent.setdefault(g, g) != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for i, j in zip(*np.nonzero(near)):
            a, b = root(int(groups[x[i]])), root(int(groups[y[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                ends.append((int(nodes[x[i]]), int(nodes[y[j]])))
    return pa.table({"a": pa.array([e[0] for e in ends], pa.int64()), "b": pa.array([e[1] for e in ends], pa.int64())})


def _links(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found by comparing side 0 with side 1 of every task (``i``, ``j``); side 0 with itself if alone."""
    rows = tasks.join(sets, "node").select("i", "j", "side", "node", "group", "hashes")
    return stage(rows.groupBy("i", "j").applyInArrow(_joining_links, "a long, b long"), "jaccard-links")


def _star_tasks(shared: DataFrame) -> DataFrame:
    """Each set against the smallest of its buckets; a hub meets its sets some hundreds at a time."""
    fits = F.least("size", "least.size") >= MIN_SIMILARITY * F.greatest("size", "least.size")
    rays = shared.where((F.col("node") != F.col("least.node")) & fits).groupBy("node").agg(F.min("least.node").alias("i"), F.first("size").alias("size"))
    sums = prefix_sums(rays.withColumn("weight", F.greatest("size", F.lit(LEAST_WEIGHT))), ["i"], ["node"], "weight", "before")
    rays = stage(sums.select("i", F.expr(f"before DIV {TILE_WEIGHT}").alias("j"), "node"), "jaccard-rays")
    hubs = rays.select("i", "j").distinct().select("i", "j", F.lit(0).alias("side"), F.col("i").alias("node"), F.col("i").alias("group"))
    return hubs.unionByName(rays.select("i", "j", F.lit(1).alias("side"), "node", F.col("node").alias("group")))


def _tile_tasks(placed: DataFrame) -> DataFrame:
    """Pairs of tiles that share buckets, each with the sets that stand in a bucket with another group of the other tile.

    Sets that share their first bucket are in the same or neighbouring tiles, so a set goes to few
    pairs of tiles however many buckets it shares with them.
    """
    nodes = placed.groupBy("node").agg(F.min(F.struct("t", "key")).alias("home"), F.first("size").alias("size"))
    flat = nodes.select("node", "home.t", "home.key", F.greatest("size", F.lit(LEAST_WEIGHT)).alias("weight"))
    sums = prefix_sums(flat, [], ["t", "key", "node"], "weight", "before")
    tiles = stage(sums.select("node", F.expr(f"before DIV {TILE_WEIGHT}").alias("tile")), "jaccard-tiles")
    held = stage(placed.join(tiles, "node").select("t", "key", "tile", "node", "group"), "jaccard-held")
    cells = held.groupBy("t", "key", F.col("tile").alias("other")).agg(F.min("group").alias("low"), F.max("group").alias("high"))
    # One row per bucket with its tiles, so that the join makes a row per set and bucket, and no more.
    tiled = cells.groupBy("t", "key").agg(F.collect_list(F.struct("other", "low", "high")).alias("cells"))
    apart = F.filter("cells", lambda c: (c["low"] != F.col("group")) | (c["high"] != F.col("group")))
    meets = held.join(tiled, ["t", "key"]).select("tile", "node", "group", F.transform(apart, lambda c: c["other"]).alias("others"))
    others = F.array_distinct(F.flatten(F.collect_list("others")))  # of as many buckets as there are bands
    paired = meets.groupBy("tile", "node", "group").agg(others.alias("others")).withColumn("other", F.explode("others"))
    return paired.select(
        F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"),
        "node", "group",
    )


def _alike(made: DataFrame) -> DataFrame:
    """Sets that SimHash links, as buckets (number ``BANDS``) of their components: op7's fingerprints, bit planes and links."""
    sets = made.where("size > 0").select("node", "size", "fingerprint").distinct()
    roots = components(link_values(sets.select(F.col("fingerprint").alias("v")).distinct())).select(F.col("node").alias("fingerprint"), "root")
    return sets.join(roots, "fingerprint", "left").select("node", "size", F.lit(BANDS).alias("t"), F.coalesce("root", "fingerprint").alias("key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents that links of Jaccard similarity ``MIN_SIMILARITY`` or more connect.

    Returns ``doc_id``, ``text_hash`` and ``root`` (the group's key) for every row.  Sets that SimHash
    groups are candidates, and so are those that share a MinHash band, as sets of that similarity may differ
    in more bits than fingerprints can be looked up by.  Every link is checked on the whole sets.  Each set is compared
    with the smallest of its buckets first; then those that share a bucket with another group, in
    pairs of tiles of bounded size.  A pair of tiles gives at most as many links as it joins groups,
    however many pairs of sets it compares.  Equal sets are one node, also of different ``doc_id``.
    Null texts and texts without words are one group, and so have one root; repeated rows have a row
    each.  Other columns are ignored; an empty table gives no rows.
    """
    made = stage(signatures(docs), "jaccard")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = stage(made.groupBy("node").agg(F.min(first).alias("first")), "jaccard-nodes")
    keyed = made.select("node", "size", F.posexplode("bands").alias("t", "key")).distinct()
    keyed = keyed.unionByName(stage(_alike(made), "jaccard-alike"))
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("least")).where("n > 1")
    shared = stage(keyed.join(buckets, ["t", "key"]), "jaccard-buckets")
    sets = _sets_of(shared.select("node").distinct(), firsts, docs)
    links = _links(_star_tasks(shared), sets)
    roots = components(links)
    placed = shared.join(roots, "node", "left").select("t", "key", "node", "size", F.coalesce("root", "node").alias("group"))
    placed = stage(placed, "jaccard-placed")
    mixed = placed.groupBy("t", "key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("t", "key")
    more = _links(_tile_tasks(placed.join(mixed, ["t", "key"])), sets)
    roots = components(links.union(more))
    found = made.select("doc_id", "text_hash", "node").join(roots, "node", "left")
    return found.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id (nulls last).

    Of several texts under that id the one with the smallest hash stays, and of equal rows one.  All
    columns of ``docs`` are returned, whatever their names.
    """
    return keep_firsts(docs, stage(near_duplicates(docs), "jaccard-groups"))
