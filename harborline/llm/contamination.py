"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborline.llm.textio import byte_chunks, free_name, mix64, same
from harborline.session import stage

SHINGLE_WORDS, MIN_CONTAINMENT = 5, 0.8
#: Text of the items that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 8 << 20

#: Words are runs of ASCII letters, digits and anything beyond ASCII; A-Z count as a-z.
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BYTE = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _BYTE[_c] = _c
_BYTE[65:91] = np.arange(97, 123)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, up to ``n``."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mapped = _BYTE[data]
    inside = mapped != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mapped * power[:n], out=sums[1:])
    hashes = mix64((sums[last] - sums[first]) * inverse[first])
    return hashes, np.searchsorted(offsets, first, "right") - 1


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``length`` words that lies in one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, length, np.uint64)
    for i in range(length):
        total += hashes[i : i + n] * _STEPS[i]
    whole = rows[:n] == rows[length - 1 :]
    return mix64(total[whole]), rows[:n][whole]


def _shingles(tokens: list[str], length: int) -> set[str]:
    return {" ".join(tokens[i : i + length]) for i in range(len(tokens) - length + 1)}


@dataclass
class Partition:
    """Items of like size: the sketches of all of them, as one sorted array of hashes."""

    length: int
    least: int
    sketch: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    items: list[tuple[object, int, frozenset]]
    partitions: list[Partition]
    seen: np.ndarray


def build_index(items: Iterable[tuple[object, str]], containment: float = MIN_CONTAINMENT) -> Index:
    """Sketch the items, by number of shingles in powers of two.

    A text holding at least ``need`` of an item's n shingles holds one of any n - need + 1 of them.
    The sketch is that many smallest hashes (a bottom-k MinHash), so the search loses nothing; only
    its size depends on the partition's sizes.  Items of fewer than five words are one shingle.
    """
    kept, groups = [], {}
    for item, text in items:
        tokens = words(text)
        if not tokens:
            continue
        length = min(SHINGLE_WORDS, len(tokens))
        found = frozenset(_shingles(tokens, length))
        groups.setdefault((length, len(found).bit_length()), []).append(len(kept))
        kept.append((item, length, found))
    partitions, seen = [], np.zeros(1 << 22, bool)
    for (length, size), members in sorted(groups.items()):
        sketch, owner = [], []
        for i in members:
            n = len(kept[i][2])
            data = "\n".join(kept[i][2]).encode()
            lines = np.cumsum([0] + [len(s.encode()) + 1 for s in kept[i][2]])
            lines[-1] -= 1
            made, _ = shingle_hashes(*word_hashes(np.frombuffer(data, np.uint8), lines), length)
            smallest = np.sort(np.unique(made))[: n - math.ceil(containment * n - 1e-9) + 1]
            sketch.append(smallest)
            owner.append(np.full(len(smallest), i))
        sketch, owner = np.concatenate(sketch), np.concatenate(owner)
        order = np.argsort(sketch, kind="stable")
        seen[sketch & np.uint64(len(seen) - 1)] = True
        least = math.ceil(containment * (1 << (size - 1)) - 1e-9)
        partitions.append(Partition(length, least, sketch[order], owner[order]))
    return Index(kept, partitions, seen)


def candidates(index: Index, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """Pairs (row, item) where the row's text holds a shingle of the item's sketch."""
    hashes, rows = word_hashes(data, offsets)
    found: set[tuple[int, int]] = set()
    for length in sorted({p.length for p in index.partitions}):
        made, where = shingle_hashes(hashes, rows, length)
        counts = np.bincount(where, minlength=len(offsets) - 1)
        hit = np.flatnonzero(index.seen[made & np.uint64(len(index.seen) - 1)])
        made, where = made[hit], where[hit]
        for p in index.partitions:
            if p.length != length or not len(made):
                continue
            lo, hi = np.searchsorted(p.sketch, made, "left"), np.searchsorted(p.sketch, made, "right")
            for i in np.flatnonzero((hi > lo) & (counts[where] >= p.least)):
                found.update((int(where[i]), int(item)) for item in p.owner[lo[i] : hi[i]])
    return found


def _search(docs: DataFrame, index: Index, schema: str, arrow: pa.Schema, containment: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            rows, hits = [], []
            for start, _, data, offsets in byte_chunks(part.column(2), 1 << 18):
                by_row: dict[int, list[int]] = {}
                for row, item in sorted(candidates(known, data, offsets)):
                    by_row.setdefault(row, []).append(item)
                for row, items in by_row.items():
                    tokens = words(data[offsets[row] : offsets[row + 1]].tobytes().decode())
                    own: dict[int, set] = {}
                    for i in items:
                        item, length, wanted = known.items[i]
                        if length not in own:
                            own[length] = _shingles(tokens, length)
                        common = len(wanted & own[length])
                        if common >= math.ceil(containment * len(wanted) - 1e-9):
                            rows.append(start + row)
                            hits.append((item, len(wanted), common, common / len(wanted)))
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take),
                        *[pa.array([h[k] for h in hits], arrow.field(k).type) for k in range(4)],
                    ],
                    names=["doc_id", "text_hash", *arrow.names],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = MIN_CONTAINMENT) -> DataFrame:
    """Benchmark items of whose distinct five-word shingles a document holds the share ``containment`` or more.

    Returns ``doc_id``, ``text_hash``, ``item_id``, ``n_shingles`` (of the item), ``n_shared`` and
    ``containment``, a row per document row and item.  The items are the stated query set: they come
    to the driver in blocks of ``BLOCK_BYTES`` and each block is looked for in all documents.

    Items that are null or without words match nothing, items of fewer than five words match as one
    whole shingle, repeated items count once.  Null and empty documents hold nothing; repeated
    documents each have their rows.  Other columns are ignored; empty tables give no rows.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, text_hash long, item_id {item_type}, n_shingles int, n_shared int, containment double"
    wanted = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    arrow = pa.schema([("item_id", to_arrow_type(benchmark.schema["item_id"].dataType)), ("n_shingles", pa.int32()), ("n_shared", pa.int32()), ("containment", pa.float64())])

    def blocks() -> Iterator[list[tuple[object, str]]]:
        block, size = [], 0
        for row in wanted.toLocalIterator():
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
            if size > BLOCK_BYTES:
                yield block
                block, size = [], 0
        yield block

    found: DataFrame | None = None
    last = None
    for block in blocks():
        if last is not None:  # each block's rows are written once
            written = stage(last, "contained")
            found = written if found is None else found.union(written)
        last = _search(docs, build_index(block, containment), schema, arrow, containment)
    return last if found is None else found.union(last)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; see :func:`contained_items`.

    All columns of ``docs`` are kept, whatever their names.
    """
    own = free_name("text_hash", docs)
    bad = contained_items(docs, benchmark).select("doc_id", F.col("text_hash").alias(own)).distinct()
    hashed = docs.withColumn(own, F.xxhash64("text"))
    return hashed.join(bad, same(hashed, bad, ["doc_id", own]), "left_anti").drop(own)


ORACLE = r"""
WITH i AS (
  SELECT DISTINCT item_id, regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT item_id, w, least(5, len(w)) AS m FROM i WHERE len(w) > 0
), ks AS (
  SELECT DISTINCT item_id, w AS item, m, array_to_string(w[p + 1 : p + m], ' ') AS s FROM (SELECT *, unnest(range(len(w) - m + 1)) AS p FROM k)
), n AS (SELECT item_id, item, count(*)::INT AS n_shingles FROM ks GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, m, array_to_string(w[p + 1 : p + m], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(greatest(len(w) - m + 1, 0))) AS p FROM d, (SELECT DISTINCT m FROM k))
), c AS (
  SELECT doc_id, item_id, item, count(*)::INT AS n_shared FROM ds JOIN ks USING (m, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM c JOIN n USING (item_id, item) WHERE n_shared >= 0.8 * n_shingles
""".format(lower="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
