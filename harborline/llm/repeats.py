"""Exact repeats of long byte strings across documents, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.textio import byte_chunks, mix64
from harborline.session import stage, unstage

THRESHOLD = 100
#: Length of the leading digit, in bytes.
DIGIT = 32

_BASE = 0x9E3779B97F4A7C15 | 1
#: One 64-bit value per byte, from a fixed generator.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`string_hashes` takes the hash of any substring."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _power_tables(len(sums))[1][start]


def runs(sums: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD):
    """Cut the suffixes of each text into runs that share the place of their leading digit.

    A suffix of at least ``threshold`` bytes is keyed by the digit with the smallest hash among
    those inside its first ``threshold`` bytes (the leftmost if equal): equal strings of that length
    have equal digits at equal distance.  Neighbouring suffixes mostly share the place, so one row
    stands for a run of them.  Returns row, first suffix, number of suffixes, digit and place of the
    digit of every run, places relative to ``data``.
    """
    empty = np.empty(0, np.int64)
    n = len(sums) - threshold
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64), empty
    hashes = sums[DIGIT:] - sums[:-DIGIT]
    hashes *= _power_tables(len(sums))[1][: len(hashes)]
    key = hashes ^ (hashes >> np.uint64(32))
    key *= np.uint64(0x9FB21C651E98DF25)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(hashes), dtype=np.uint64)
    width, step = threshold - DIGIT + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: n], key[width - step : width - step + n])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    change = np.zeros(n + 1, bool)
    change[0] = True
    change[1:n] = place[1:] != place[:-1]
    starts = offsets[:-1][lengths >= threshold]
    stops = (offsets[1:] - threshold + 1)[lengths >= threshold]
    change[starts] = True
    change[stops] = True
    first = np.flatnonzero(change[:n])
    count = np.diff(np.append(first, n))
    row = np.searchsorted(offsets, first, "right") - 1
    valid = first + threshold <= offsets[row + 1]
    first, count, row = first[valid], count[valid], row[valid]
    return row, first, count, hashes[place[first]], place[first]


#: Layout of a run's place in a long: first suffix, number less one, distance of the digit.
_FIRST, _COUNT = 14, 7
#: Suffixes per part in the passes below the whole run.
PARTS = (8, 1)
_NO_ID = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """Document key: the id (null last) and the text's 64-bit hash, which tells texts under one id apart."""
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"),
        F.xxhash64("text").alias("tie"), "text",
    )


def _pack(first: np.ndarray, count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (first << _FIRST) | ((count - 1) << _COUNT) | distance


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> _FIRST) & 0x7FFFFFFF, ((place >> _COUNT) & 127) + 1, place & 127


def _table(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _all_runs(docs: DataFrame, threshold: int) -> DataFrame:
    """Every run of every document: document ``d``, ``tie``, ``place``, ``digit``, hash of the ``whole`` run's bytes."""
    schema = pa.schema([(n, pa.int64()) for n in ("d", "tie", "place", "digit", "whole")])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, ties = part.column(0).to_numpy(), part.column(1).to_numpy()
            for start, _, data, offsets in byte_chunks(part.column(2), 1 << 16):
                sums = prefix_hashes(data)
                row, first, count, digit, place = runs(sums, offsets, threshold)
                whole = string_hashes(sums, first, first + count - 1 + threshold)
                packed = _pack(first - offsets[row], count, place - first)
                yield _table(schema, ids[start + row], ties[start + row], packed, digit, whole)

    return docs.select("d", "tie", "text").mapInArrow(work, "d long, tie long, place long, digit long, whole long")


def _run_texts(docs: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """``wanted`` (d, tie, place, digit) with the bytes that each run's suffixes cover."""
    places = wanted.groupBy("d", "tie").agg(
        F.collect_list("place").alias("places"), F.collect_list("digit").alias("digits")
    )
    joined = docs.select("d", "tie", F.encode("text", "UTF-8").alias("data")).join(places, ["d", "tie"])
    schema = pa.schema([("d", pa.int64()), ("tie", pa.int64()), ("place", pa.int64()), ("digit", pa.int64()), ("span", pa.binary())])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for d, tie, data, places, digits in zip(*(part.column(i) for i in range(5))):
                text, place = data.as_py(), np.array(places.values)
                first, count, _ = _unpack(place)
                ends = (first + count - 1 + threshold).tolist()
                spans = [text[a:b] for a, b in zip(first.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(place), k.as_py())) for k in (d, tie)), pa.array(place), digits.values, pa.array(spans, pa.binary())],
                    schema=schema,
                )

    return joined.select("d", "tie", "data", "places", "digits").mapInArrow(
        work, "d long, tie long, place long, digit long, span binary"
    )


def _cut(run_texts: DataFrame, length: int, threshold: int) -> DataFrame:
    """The parts of up to ``length`` suffixes of each run, aligned by distance from the digit.

    ``core`` is the hash of the bytes that all suffixes of a full part have in common.
    """
    names = ("d", "tie", "place", "digit", "core", "whole", "parent")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d, tie, place, digit = (part.column(i).to_numpy() for i in range(4))
            first, count, distance = _unpack(place)
            for start, end, data, offsets in byte_chunks(part.column(4), 1 << 16):
                here = slice(start, end)
                row = np.repeat(np.arange(start, end), count[here])
                step = np.arange(len(row)) - np.repeat(np.cumsum(count[here]) - count[here], count[here])
                part_no = (distance[row] - step) // length
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (part_no[1:] != part_no[:-1])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(row)))
                owner, ahead = row[at], step[at]
                begin = offsets[owner - start] + ahead
                sums = prefix_hashes(data)
                whole = string_hashes(sums, begin, begin + size - 1 + threshold)
                middle = offsets[owner - start] + distance[owner] - length * part_no[at]
                core = string_hashes(sums, middle, middle + threshold - length + 1)
                packed = _pack(first[owner] + ahead, size, distance[owner] - ahead)
                yield _table(schema, d[owner], tie[owner], packed, digit[owner], core, whole, place[owner])

    return run_texts.select("d", "tie", "place", "digit", "span").mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _first_of_each(rows: DataFrame, bucket: list[str], carry: list[str]) -> DataFrame:
    """One pass of the sort: of the rows with equal ``whole`` in a bucket the first."""
    firsts = rows.groupBy(*bucket, "whole").agg(F.min(F.struct("d", "tie", "place", *carry)).alias("at"))
    return firsts.select(*bucket, "at.*")


def _marked(firsts: DataFrame, bucket: list[str]) -> DataFrame:
    """Stage ``firsts``, then with ``open`` if a row's bucket has several.

    Shorter strings of those may be equal, so they go to the next pass.
    """
    spark = firsts.sparkSession
    rows = stage(firsts, "repeats-pass")
    unstage(spark)
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stage(counts.select(*bucket, F.lit(True).alias("open")), "repeats-several")
    marked = stage(rows.join(several, bucket, "left").withColumn("open", F.coalesce("open", F.lit(False))), "repeats-marked")
    unstage(spark, rows, several)
    return marked


def find_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Remove every byte covered by a ``threshold``-byte string that also starts earlier.

    Earlier is a smaller ``doc_id`` (null last) or an earlier start in the same document.  Returns
    per row ``doc_id``, ``n_bytes``, ``spans`` (removed bytes, start and end exclusive, maximal) and
    ``kept`` (the other bytes in order).

    The suffixes are sorted by digits, the most significant first, and no deeper than the threshold.
    The first digit comes from the run a suffix lies in (:func:`runs`); runs whose digit no other run
    has fall out.  The next digit is the whole run's text: copies of a run have copies of all its
    strings, so only the first of each class goes on, and it is done if it is the bucket's only
    class.  The last passes cut what is left into parts of eight suffixes, bucketed by the bytes these
    have in common, and into single ones, where equal groups are exactly the repeated strings.  A string is equal to another if two
    64-bit hashes of it are.

    Null and empty texts have no bytes.  Texts under one id count as different documents in the
    order of a hash; equal rows are one document and get the same result.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    every = _all_runs(keyed, threshold)
    # written, so that the join has an exchange on both sides and Spark can split a digit that is everywhere
    shared = stage(every.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), "repeats-digits")
    unstage(spark)
    hits = stage(every.join(shared, "digit"), "repeats-runs")
    unstage(spark, shared)
    alive = []
    done = _marked(_first_of_each(hits, ["digit"], []), ["digit"])
    repeated = stage(hits.select("d", "tie", "place"), "repeats-hits")
    unstage(spark, hits)
    used = [done]
    alive.append(done.where("not open").select("d", "tie", "place"))
    texts = rest = stage(_run_texts(keyed, done.where("open"), threshold), "repeats-texts")
    unstage(spark)
    used.append(texts)
    for length in PARTS:
        parts = _first_of_each(_cut(rest, length, threshold), ["digit", "core"], ["parent"])
        if length == PARTS[-1]:
            alive.append(parts.select("d", "tie", "place"))
            break
        done = _marked(parts, ["digit", "core"])
        used.append(done)
        alive.append(done.where("not open").select("d", "tie", "place"))
        first = F.shiftright("place", _FIRST).bitwiseAND(F.lit(0x7FFFFFFF))
        parent = F.shiftright("parent", _FIRST).bitwiseAND(F.lit(0x7FFFFFFF))
        count = F.shiftright("place", _COUNT).bitwiseAND(F.lit(127))
        own = texts.select("d", "tie", F.col("place").alias("parent"), "span")
        rest = (
            done.where("open").join(own, ["d", "tie", "parent"])
            .withColumn("__at", (first - parent + 1).cast("int")).withColumn("__n", (count + threshold).cast("int"))
            .select("d", "tie", "place", "digit", F.expr("substring(span, __at, __n)").alias("span"))
        )
    kept_runs = stage(reduce(DataFrame.union, alive), "repeats-alive")
    unstage(spark, *used)
    return _assemble(keyed, repeated, kept_runs, threshold)


def _assemble(keyed: DataFrame, hits: DataFrame, alive: DataFrame, threshold: int) -> DataFrame:
    """What is left of each document: suffixes of ``hits`` that are not in ``alive`` are repeats."""
    marks = hits.select("d", "tie", "place", F.lit(True).alias("hit")).union(alive.select("d", "tie", "place", F.lit(False)))
    places = marks.groupBy("d", "tie").agg(
        F.collect_list(F.when(F.col("hit"), F.col("place"))).alias("hits"),
        F.collect_list(F.when(~F.col("hit"), F.col("place"))).alias("alive"),
    )
    rows = keyed.select("d", "tie", "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    joined = rows.join(places, ["d", "tie"], "left").select("doc_id", "data", "hits", "alive")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def strip(data: bytes, hits: np.ndarray, alive: np.ndarray) -> tuple[list[dict], bytes]:
        step = np.zeros(len(data) + 2, np.int32)
        first, count, _ = _unpack(hits)
        repeated = np.zeros(len(data) + 1, bool)
        np.add.at(step, first, 1)
        np.add.at(step, first + count, -1)
        repeated[:] = np.cumsum(step[:-1]) > 0
        step[:] = 0
        first, count, _ = _unpack(alive)
        np.add.at(step, first, 1)
        np.add.at(step, first + count, -1)
        repeated &= np.cumsum(step[:-1]) == 0
        where = np.flatnonzero(repeated)
        step[:] = 0
        step[where] += 1
        step[where + threshold] -= 1
        gone = np.cumsum(step[: len(data)]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2)
        return [{"start": a, "end": b} for a, b in edges.tolist()], np.frombuffer(data, np.uint8)[~gone].tobytes()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, spans, kept = [], [], []
            for data, hits, alive in zip(part.column(1), part.column(2), part.column(3)):
                data = data.as_py()
                found = ([], data)
                if hits.is_valid:
                    found = strip(data, np.array(hits.values, np.int64), np.array(alive.values, np.int64))
                sizes.append(len(data))
                spans.append(found[0])
                kept.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                schema=schema,
            )

    return joined.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
