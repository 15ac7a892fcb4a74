"""Near-duplicates by SimHash: fingerprints, bit-sliced comparison, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from harborline.llm.components import components
from harborline.llm.textio import byte_chunks, free_name, same
from harborline.session import stage

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Four blocks of 16 bits: with two bits differing, at least two blocks are equal.
BLOCKS = 4
#: Fingerprints of one bucket that are compared as one block; larger buckets are cut finer.
BLOCK_LANES = 2048
POOL_LANES = 1024
_SLICE = 1 << 15


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        counts += bit_counts(hashes[i : i + _SLICE])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    """64 majority bits over the hashes of the word shingles of one lower-cased text.

    bytes.lower and bytes.split use ASCII only, as the word pattern does.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - SHINGLE_WORDS + 1, 1)
    stop = ends[SHINGLE_WORDS - 1 :] if len(words) >= SHINGLE_WORDS else ends[-1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, last, _SLICE):
        pieces = zip(starts[i : min(i + _SLICE, last)].tolist(), stop[i : i + _SLICE].tolist())
        counts += bit_counts(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pieces], np.uint64))
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (64 bits as a long) and ``text_hash`` for every row of ``docs``."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("text_hash", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for _, _, data, offsets in byte_chunks(part.column(2)):
                found += [fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            bits = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(bits), part.column(1)], schema=schema)

    return narrow.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def linked(lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs of 64-bit values differ in at most ``radius`` (up to 2) bits; boolean matrix.

    The values stand vertically: plane k holds bit k of all lanes, 64 lanes a word.  Each lane's
    count of differing bits is kept in two bit-sliced counters and an overflow bit, to which a plane
    is added with carry-save logic for all lanes at once.  The rest of the planes is skipped for
    rows whose lanes have all overflowed.
    """
    n, width = len(lanes), -(-len(lanes) // 64) * 64
    bits = np.zeros((64, width), np.uint8)
    bits[:, :n] = np.unpackbits(lanes.view(np.uint8), bitorder="little").reshape(n, 64).T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    unused = np.packbits(np.arange(width) >= n, bitorder="little").view(np.uint64)
    flip = np.where(bits[:, :n] == 1, ~np.uint64(0), np.uint64(0))
    rows = np.arange(n)
    over_all = np.empty((n, width // 64), np.uint64)
    ones, twos = np.zeros((n, width // 64), np.uint64), np.zeros((n, width // 64), np.uint64)
    over = np.broadcast_to(unused, ones.shape).copy()
    for k in range(64):
        carry = planes[k] ^ flip[k, rows, None]
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        over |= carry
        if k % 8 == 7:
            # a count above the radius never falls again
            above = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
            alive = (above != ~np.uint64(0)).any(axis=1)
            if not alive.all():
                over_all[rows[~alive]] = ~np.uint64(0)
                rows, ones, twos, over = rows[alive], ones[alive], twos[alive], above[alive]
                if not len(rows):
                    break
            else:
                over = above
    over_all[rows] = over
    return np.unpackbits(~over_all.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _stars(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (value, root) that connect the same lanes as all links among ``lanes`` do."""
    near = linked(lanes)
    label = np.arange(len(lanes))
    while True:
        low = np.where(near, label, len(lanes)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(lanes)))
    return lanes[moved], lanes[label[moved]]


def _links_in_buckets(buckets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` connecting what is within the radius in each bucket (column ``lanes``)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            start, i = 0, 0
            a, b = [], []
            while i < len(ends):
                # small buckets share a block: what is near there is a link all the same
                j = max(int(np.searchsorted(ends, start + POOL_LANES, "right")), i + 1)
                found = _stars(np.unique(values[start : ends[j - 1]]))
                a.append(found[0])
                b.append(found[1])
                start, i = int(ends[j - 1]), j
            if a:
                yield pa.record_batch(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema
                )

    return buckets.mapInArrow(run, "a long, b long")


def link_values(values: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all of the distinct longs ``v`` within the radius.

    Values with two equal 16-bit blocks meet in a bucket.  A bucket of up to ``BLOCK_LANES`` values
    is compared as one block.  A larger one is cut again, exactly: its values meet at the values one
    bit away from them, and no more than 33 can meet there, as the bucket's own 32 bits are equal.
    """
    width = 64 // BLOCKS
    masks = [sum(((1 << width) - 1) << (width * k) for k in pair) for pair in combinations(range(BLOCKS), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("v").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    keyed = values.select("v", keys.alias("k")).select("v", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, ["t", "key"]), "simhash-buckets")
    plain = shared.where(F.col("n") <= BLOCK_LANES).groupBy("t", "key").agg(F.collect_list("v").alias("lanes"))
    flips = [
        F.array(F.col("v"), *[F.col("v").bitwiseXOR(F.lit(b - (1 << 64) if b >> 63 else b)) for b in (1 << k for k in range(64)) if not b & m])
        for m in masks
    ]
    near = F.explode(F.get(F.array(*flips), F.col("t")))
    finer = (
        shared.where(F.col("n") > BLOCK_LANES)
        .select("v", "t", near.alias("near"))
        .groupBy("t", "near").agg(F.collect_list("v").alias("lanes"))
        .where(F.size("lanes") > 1)
    )
    return _links_in_buckets(plain.select("lanes").union(finer.select("lanes")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose fingerprints connect at ``RADIUS`` or fewer differing bits.

    Returns ``doc_id``, ``text_hash``, ``fingerprint`` (16 hex digits), ``root`` (the group's key) and
    ``component_id``, the smallest id reachable, for every row.  Equal fingerprints are one node, so copies cost nothing
    beyond their own rows.  Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and ids have the same group; a null id is passed over unless a group has no other.
    Other columns are ignored; an empty table gives no rows.
    """
    made = stage(fingerprints(docs), "simhash")
    nodes = stage(made.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-values")
    roots = components(link_values(nodes.select(F.col("fingerprint").alias("v"))))
    placed = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = placed.join(firsts, "root").select("fingerprint", "root", "component_id")
    return made.join(groups, "fingerprint").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "root", "component_id"
    )


def keep_firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group ``root`` of ``found`` (``doc_id``, ``text_hash``).

    All columns of ``docs`` are kept, whatever their names.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    own = free_name("text_hash", docs)
    kept = best.select("best.doc_id", F.col("best.text_hash").alias(own))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    out = hashed.join(kept, same(hashed, kept, ["doc_id", own]), "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    return out.drop(own)
