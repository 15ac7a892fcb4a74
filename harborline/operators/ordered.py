"""Ordered per-key computations that never put one key into one task.

A plain window with ``partitionBy(key)`` sorts a whole key in one task.  Here the rows of keys with
more than ``max_group_rows`` rows are range-partitioned by key *and* order, so that a hot key spans
many chunks.  Each chunk is scanned on its own, and starts from a carry row holding the aggregate of
the chunks before it.  All other keys take the plain window.

``order_by`` columns are ascending with nulls last.  For a descending order pass a negated column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from harborline.session import stage

MAX_GROUP_ROWS = 2_000_000
# Chunks hold about this many rows.
CHUNK_ROWS = 500_000

_CHUNK, _IS_ROW = "__chunk", "__is_row"


_GROUP = "group_"


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names]


def _place(names: Sequence[str]) -> Column:
    """A value that compares as the order does."""
    return F.struct(*[c for n in names for c in (F.col(n).isNull(), F.col(n))])


def _fold(kind: str, column: Column, order: Column) -> Column:
    """Aggregate of one chunk."""
    kind = kind.removeprefix(_GROUP)
    if kind in ("sum", "count"):
        return F.sum(column)
    if kind == "min":
        return F.min(column)
    if kind == "max":
        return F.max(column)
    if kind == "last":
        return F.max_by(column, F.when(column.isNotNull(), order))
    raise ValueError(f"unknown running aggregate: {kind}")


def _scan(kind: str, column: Column, window: WindowSpec, whole: WindowSpec) -> Column:
    """Running aggregate, or for ``group_`` kinds the aggregate of the whole key."""
    if kind.startswith(_GROUP):
        kind, window = kind.removeprefix(_GROUP), whole
    if kind in ("sum", "count"):
        return F.sum(column).over(window)
    if kind == "min":
        return F.min(column).over(window)
    if kind == "max":
        return F.max(column).over(window)
    return F.last(column, ignorenulls=True).over(window)


def with_group_columns(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a per-key table; a null key is a key like any other, as in ``GROUP BY``."""
    renamed = groups.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    return df.join(renamed, condition).drop(*[f"__g_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    max_group_rows: int = MAX_GROUP_ROWS,
    peers: bool = False,
) -> DataFrame:
    """Add running aggregates, up to and including the current row, per key.

    ``aggs`` maps an output name to ``(kind, column)`` with kind ``sum``, ``count`` (non-null
    values), ``min``, ``max`` or ``last`` (latest non-null value).  ``group_sum``, ``group_count``,
    ``group_min`` and ``group_max`` are taken over all rows of the key, which saves a join with a
    table of totals.  With ``peers``, rows of equal order see each other, as in a ``RANGE`` frame.
    """
    keys, order_by = list(keys), list(order_by)
    inputs = {
        f"__in_{name}": F.when(col.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        if kind.endswith("count") else col
        for name, (kind, col) in aggs.items()
    }
    kinds = {name: kind for name, (kind, _) in aggs.items()}
    ready = df.withColumns(inputs)
    columns = list(df.columns)

    if not keys:
        return _running_in_chunks(ready, columns, keys, order_by, kinds, peers, df.count())

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_group_rows)
    hot_rows = sizes.agg(F.sum("__n")).first()[0]
    if not hot_rows:
        return _running_whole_keys(ready, columns, keys, order_by, kinds, peers)
    # Written, so that the list's size is known to the joins and it is made once for both.
    hot = stage(sizes.select(*[F.col(k).alias(f"__h_{k}") for k in keys]), "hot-keys")
    is_hot = F.lit(True)
    for k in keys:
        is_hot = is_hot & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return _running_whole_keys(
        ready.join(hot, is_hot, "left_anti"), columns, keys, order_by, kinds, peers
    ).unionByName(
        _running_in_chunks(
            ready.join(hot, is_hot, "left_semi"), columns, keys, order_by, kinds, peers, hot_rows
        )
    )


def _upto_current(window: WindowSpec, peers: bool) -> WindowSpec:
    frame = window.rangeBetween if peers else window.rowsBetween
    return frame(Window.unboundedPreceding, Window.currentRow)


def _running_whole_keys(
    ready: DataFrame, columns: list[str], keys: list[str], order_by: list[str], kinds: Mapping[str, str], peers: bool
) -> DataFrame:
    window = _upto_current(Window.partitionBy(*keys).orderBy(*_ascending(order_by)), peers)
    whole = Window.partitionBy(*keys)
    return ready.select(
        *columns, *[_scan(k, F.col(f"__in_{n}"), window, whole).alias(n) for n, k in kinds.items()]
    )


def _running_in_chunks(
    ready: DataFrame, columns: list[str], keys: list[str], order_by: list[str], kinds: Mapping[str, str], peers: bool,
    rows: int,
) -> DataFrame:
    """Rows of equal key and order share a chunk where peers see each other, so the carry rows are right for them.

    Otherwise their order is free, and they are cut by a hash of the row, so that a place shared by many rows spans chunks too.
    """
    cores = ready.sparkSession.sparkContext.defaultParallelism
    chunks = max(rows // CHUNK_ROWS, 2 * cores)
    ranges = _ascending([*keys, *order_by])
    hashable = [f.name for f in ready.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    if not peers and hashable:
        ranges.append(F.xxhash64(*hashable))
    chunked = stage(ready.repartitionByRange(chunks, *ranges).withColumn(_CHUNK, F.spark_partition_id()), "chunks")
    order = _place(order_by)
    folded = chunked.groupBy(*keys, _CHUNK).agg(
        *[_fold(k, F.col(f"__in_{n}"), order).alias(f"__in_{n}") for n, k in kinds.items()]
    )
    before = (
        Window.partitionBy(*keys).orderBy(_CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    every = Window.partitionBy(*keys)
    carry = folded.select(
        *keys, _CHUNK,
        *[_scan(k, F.col(f"__in_{n}"), before, every).alias(f"__in_{n}") for n, k in kinds.items()],
        F.lit(0).alias(_IS_ROW),
    )
    within = _upto_current(Window.partitionBy(*keys, _CHUNK).orderBy(_IS_ROW, *_ascending(order_by)), peers)
    return (
        chunked.withColumn(_IS_ROW, F.lit(1))
        .unionByName(carry, allowMissingColumns=True)
        .select(
            *columns, _IS_ROW,
            *[
                (F.first(f"__in_{n}").over(within) if k.startswith(_GROUP)
                 else _scan(k, F.col(f"__in_{n}"), within, within)).alias(n)
                for n, k in kinds.items()
            ],
        )
        .where(F.col(_IS_ROW) == 1)
        .drop(_IS_ROW)
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "row_index",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """1-based position of each row within its key; ``order_by`` must be unique within a key."""
    return running(df, keys, order_by, {name: ("count", F.lit(1))}, max_group_rows)


def rows_frame(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    before: int,
    after: int,
    aggs: Mapping[str, Callable[[WindowSpec], Column]],
    block_rows: int = 500_000,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Window functions over ``ROWS BETWEEN before PRECEDING AND after FOLLOWING``.

    Each key is cut into blocks of ``block_rows`` positions.  Rows that frames of a neighbouring
    block reach are copied there, so every frame is whole and no task holds more than one block
    and its margins.  ``aggs`` builds each output from a window ordered by position; the window
    carries no frame, so both framed and positional (lag, lead) functions can be used.
    """
    keys = list(keys)
    columns = list(df.columns)
    placed = row_index(df, keys, order_by, "__pos", max_group_rows).withColumn(
        "__pos", F.col("__pos") - 1
    )
    home = F.floor(F.col("__pos") / block_rows)
    copies = F.sequence(
        F.floor(F.greatest(F.col("__pos") - after, F.lit(0)) / block_rows),
        F.floor((F.col("__pos") + before) / block_rows),
    )
    window = Window.partitionBy(*keys, "__block").orderBy("__pos")
    return (
        placed.withColumn("__block", F.explode(copies))
        .select(
            *columns, "__pos", "__block",
            *[build(window).alias(name) for name, build in aggs.items()],
        )
        .where(F.col("__block") == home)
        .drop("__pos", "__block")
    )


def peer_ranks(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` per distinct order value.

    Rows with equal order values (peers) are counted before any shuffle, so a value that most rows
    share costs one row here.  For per-row ranks add the result with :func:`with_group_columns` on
    ``keys + order_by``, where a null is a value like any other.
    """
    keys, order_by = list(keys), list(order_by)
    peers = stage(df.groupBy(*keys, *order_by).agg(F.count(F.lit(1)).alias("peers")), "peers")
    joined = running(
        peers, keys, order_by,
        {"__upto": ("sum", F.col("peers")), "dense_rank": ("count", F.lit(1)),
         "__total": ("group_sum", F.col("peers"))},
        max_group_rows,
    )
    rank = F.col("__upto") - F.col("peers") + 1
    return joined.select(
        *keys, *order_by, "peers",
        rank.alias("rank"),
        "dense_rank",
        F.when(F.col("__total") > 1, (rank - 1) / (F.col("__total") - 1)).otherwise(F.lit(0.0))
        .alias("percent_rank"),
        (F.col("__upto") / F.col("__total")).alias("cume_dist"),
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    right_columns: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time.

    Both sides are merged into one ordered stream and the latest right row is carried forward, so
    no pair of rows is built.  Left rows without an earlier right row get nulls, and so do those with a
    null key or time: null equals nothing, as in SQL.
    """
    keys = list(keys)
    merged = left.select(
        *keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
    ).unionByName(
        right.select(
            *keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"),
            F.struct(*[F.col(c) for c in right_columns]).alias("__right"),
        ).where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, "__ts")])),
        allowMissingColumns=True,
    )
    carried = running(
        merged, keys, ["__ts", "__side"], {"__match": ("last", F.col("__right"))}, max_group_rows
    )
    known = F.col("__ts").isNotNull()
    return carried.where(F.col("__side") == 1).select(
        "__left.*", *[F.when(known, F.col("__match")[c]).alias(c) for c in right_columns]
    )


def trailing_extrema(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: Column,
    min_name: str, max_name: str, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Least and greatest value over ``RANGE BETWEEN seconds PRECEDING AND CURRENT ROW``.

    Extrema cannot be taken back when a row leaves, so time is cut into blocks as long as the frame.  A
    frame is then the end of one block and the beginning of the next: a scan of each block forwards
    gives the beginnings with the row's peers, and one backwards, in which every row asks at the time
    its frame opens, the ends.  No frame is evaluated by itself; rows of a block are at most two.
    Rows without a time are each other's frame, as in SQL.
    """
    keys, columns = list(keys), list(df.columns)
    kind = df.select(value).schema[0].dataType
    length = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = df.withColumns({"__at": micros, "__block": F.floor(micros / length), "__v": value})
    begun = running(
        placed, [*keys, "__block"], ["__at"], {"__min": ("min", F.col("__v")), "__max": ("max", F.col("__v"))}, max_group_rows, peers=True
    )
    # Backwards: the values of a block, and after those of its time the rows whose frames open there.
    asked = F.array(
        F.struct((-F.col("__at")).alias("back"), F.col("__block").alias("block"), F.lit(0).alias("phase"), F.col("__v").alias("v")),
        F.struct((length - F.col("__at")).alias("back"), (F.col("__block") - 1).alias("block"), F.lit(1).alias("phase"), F.lit(None).cast(kind).alias("v")),
    )
    both = begun.withColumn("__e", F.explode(asked)).select(
        *[(F.when(F.col("__e.phase") == 1, F.col(c)) if c not in keys else F.col(c)).alias(c) for c in (*columns, "__min", "__max")],
        F.col("__e.block").alias("__block"), F.col("__e.back").alias("__back"), F.col("__e.phase").alias("__phase"), F.col("__e.v").alias("__v"),
    )
    ended = running(
        both, [*keys, "__block"], ["__back", "__phase"], {"__low": ("min", F.col("__v")), "__high": ("max", F.col("__v"))}, max_group_rows
    )
    return ended.where("__phase = 1").select(
        *columns, F.least("__min", "__low").alias(min_name), F.greatest("__max", "__high").alias(max_name)
    )


def trailing_sum(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: Column,
    sum_name: str, count_name: str, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sum and count over ``RANGE BETWEEN seconds PRECEDING AND CURRENT ROW``.

    Every row enters at its time and leaves after ``seconds``; a running sum over these changes is
    the frame's sum at each row.  ``value`` should be a whole number (or a decimal, which is slower)
    so that what leaves is exactly what entered.
    """
    keys, columns = list(keys), list(df.columns)
    later = F.col(ts) + F.expr(f"INTERVAL {seconds} SECONDS")
    # At one instant rows enter (0) before rows of that age leave (1): both ends belong to a frame.
    changes = df.withColumn(
        "__change",
        F.explode(F.array(
            F.struct(F.col(ts).alias("at"), F.lit(0).alias("phase"), value.alias("v"), F.lit(1).cast("bigint").alias("c")),
            F.struct(later.alias("at"), F.lit(1).alias("phase"), (-value).alias("v"), F.lit(-1).cast("bigint").alias("c")),
        )),
    ).select(
        *[(F.when(F.col("__change.phase") == 0, F.col(c)) if c not in keys else F.col(c)).alias(c) for c in columns],
        F.col("__change.at").alias("__at"), F.col("__change.phase").alias("__phase"),
        F.col("__change.v").alias("__v"), F.col("__change.c").alias("__c"),
    )
    summed = running(
        changes, keys, ["__at", "__phase"],
        {sum_name: ("sum", F.col("__v")), count_name: ("sum", F.col("__c"))}, max_group_rows, peers=True,
    )
    return summed.where(F.col("__phase") == 0).drop("__at", "__phase", "__v", "__c")
