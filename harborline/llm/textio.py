"""Shared small helpers: texts as byte arrays inside Arrow tasks, null-safe joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the contracts are runs of anything but these bytes (space and 0x09 to 0x0D).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def byte_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of whole texts of about ``limit`` bytes.

    Yields first row, end row, the bytes of the texts one after the other, and the rows' offsets in
    them.  Null counts as empty.  A text above the limit is a run by itself.
    """
    column = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (splitmix finaliser) and return them."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores after it as make it differ from all columns, in any case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    """Join condition on columns of both sides where null equals null."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def span_digest(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined, in the array's order."""
    column = F.col(spans)
    if kinds is not None:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds) & s["base"])
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: (s["kind"] == kind) & s["base"])).cast("long")
