"""Joins on ranges, intervals and prefixes, rewritten as equi joins Spark can shuffle or broadcast.

No broadcast is forced here: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import stage

_OPEN_LEVEL = 99
#: Cells of overlap joins are this many times as wide as the ranges of their level, so that few ranges are in two of them.
_ROOM = 4
#: Overlap joins without keys: rows of a part of a cell, rows of a block on either side, pairs of rows that share a cell for a task.
_PART_ROWS, _LEFT_BLOCK, _RIGHT_BLOCK, _TASK_PAIRS = 1 << 14, 128, 256, 1 << 26


def range_join(
    points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, keys: Sequence[str] = (),
) -> DataFrame:
    """Points with every range of the same ``keys`` that holds ``low <= value < high``.

    A range is joined on the two or three cells it touches at the level whose cells, ``width`` times a
    power of four, are as wide as it is.  Points are spelled out once per level that ranges have, so
    the copies of a row do not depend on how wide ranges are.  Ranges without an end, or too wide for
    numbered cells, share one cell of a last level.  Empty ranges and nulls match nothing.
    """
    cell = _cell(width)
    cells = F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    open_level = F.col("__level") == _OPEN_LEVEL
    placed = (
        ranges.where(F.col(low) < F.col(high)).withColumn("__level", _level(low, high, width))
        .withColumn("__bucket", F.explode(F.when(open_level, F.array(F.lit(0).cast("bigint"))).otherwise(cells)))
    )
    levels = [r[0] for r in placed.select("__level").distinct().collect()]  # about 30 at most
    return (
        points.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
        .withColumn("__bucket", F.when(open_level, F.lit(0).cast("bigint")).otherwise(F.floor(F.col(value) / cell)))
        .join(placed, [*keys, "__level", "__bucket"])
        .where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))
        .drop("__level", "__bucket")
    )


def overlap_join(
    left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, keys: Sequence[str] = (),
    left_sizes: DataFrame | None = None,
) -> DataFrame:
    """Pairs of rows of the same ``keys`` whose ranges ``[low, high)`` overlap, each pair once.

    Two ranges that overlap do so where the later of them begins.  They meet in the cell that holds
    this place, at the level of the wider one: a range is narrower than the cells of its level, so it
    has one or two there, and as many at each higher level that ranges of the other side have.  One join finds all pairs, and neither copies of pairs nor a pass to remove them are needed.
    Without ``keys`` all rows share the cells and pairs grow with the square of the tables: blocks of rows are joined then
    (:func:`_join_blocks`), and columns must be ones that Spark can hash.
    Levels are read from the tables; ``left_sizes``, with the bounds of the rows of ``left`` and maybe
    of more, is read instead of a ``left`` that is dear to make.  Bounds are numbers; all columns but
    ``keys`` must differ in name.  Empty ranges and nulls match nothing.
    """
    (a, b), (c, d) = left_range, right_range
    lefts, rights = left.where(F.col(a) < F.col(b)), right.where(F.col(c) < F.col(d))
    names = [*left.columns, *[n for n in right.columns if n not in keys]]
    in_left = _levels(lefts if left_sizes is None else left_sizes.where(F.col(a) < F.col(b)), a, b, width)
    in_right = _levels(rights, c, d, width)
    placed_left = _place(lefts, a, b, width, in_left, in_right).withColumnsRenamed({"__own": "__own_left", "__first": "__first_left"})
    placed_right = _place(rights, c, d, width, in_right, in_left).withColumnsRenamed({"__own": "__own_right", "__first": "__first_right"})
    if not keys:
        return _join_blocks(placed_left, placed_right, left.columns, right.columns, left_range, right_range).select(*names)
    return (
        placed_left.join(placed_right, [*keys, "__level", "__bucket"])
        .where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & _once())
        .select(*names)
    )


def _once() -> Column:
    """Of the cells that two ranges share, the one at the level of the wider where the later begins."""
    return (F.col("__own_left") | F.col("__own_right")) & (F.col("__first_left") | F.col("__first_right"))


def _join_blocks(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of placed rows of the same cell whose ranges overlap, each pair once, in an order that takes little disk.

    The rows of a cell are dealt to parts by their hash, sorted in each, and cut into blocks.  Any two parts of a cell
    meet under a key of their own, so that a cell however full is dealt to many tasks; rows of a cell that the other side
    has not are dropped before they move.  A row of a left block is spelled out with all of a right block before the next
    row is.  Neighbours overlap mostly the same ranges, so columns of the left become long runs, those of the right repeat
    in step, and what is written takes a part of the disk that pairs in another order do.
    """
    (a, b), (c, d) = left_range, right_range
    cell, place = ["__level", "__bucket"], ["__level", "__bucket", "__part_left", "__part_right"]
    counts = [df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "__lefts"), (right, "__rights"))]
    cells = stage(counts[0].join(counts[1], cell), "cells")
    pairs = cells.agg(F.sum(F.col("__lefts").cast("double") * F.col("__rights"))).first()[0] or 0
    tasks = max(1, math.ceil(pairs / _TASK_PAIRS))
    parts = cells.select(*cell, *[F.ceil(F.col(n) / _PART_ROWS).alias(n) for n in ("__lefts", "__rights")])
    lefts = _blocks(left.join(parts, cell), left_columns, a, b, "left", "right", _LEFT_BLOCK).repartition(tasks, *place)
    rights = _blocks(right.join(parts, cell), right_columns, c, d, "right", "left", _RIGHT_BLOCK).repartition(tasks, *place)
    low, high, x, y = (F.col(n) for n in ("__low_right", "__high_right", "__row_left", "__row_right"))
    return (
        lefts.join(rights, place)
        .where((F.col("__low_left") < high) & (low < F.col("__high_left")) & _once())
        # Generated code holds all that it makes of one row: this filter, which is not compiled, parts the join from it.
        .select("__rows_right", F.filter("__rows_left", lambda row: (row[a] < high) & (low < row[b])).alias("__rows_left"))
        .select("__rows_right", F.explode("__rows_left").alias("__row_left"))
        .select("__row_left", F.explode("__rows_right").alias("__row_right"))
        .where((x[a] < y[d]) & (y[c] < x[b]))
        .select("__row_left.*", "__row_right.*")
    )


def _blocks(placed: DataFrame, columns: Sequence[str], low: str, high: str, side: str, other: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` neighbouring rows of a part of a cell, once for each part that the other side has there."""
    cell, part, flags = ["__level", "__bucket"], f"__part_{side}", [f"__own_{side}", f"__first_{side}"]
    in_part = Window.partitionBy(*cell, part).orderBy(*flags, low, high)
    return (
        placed.withColumn(part, F.pmod(F.xxhash64(*columns), F.col(f"__{side}s")))
        .withColumn("__block", F.floor((F.row_number().over(in_part) - 1) / size))
        .groupBy(*cell, part, *flags, "__block", f"__{other}s")
        .agg(F.min(low).alias(f"__low_{side}"), F.max(high).alias(f"__high_{side}"), F.collect_list(F.struct(*columns)).alias(f"__rows_{side}"))
        .withColumn(f"__part_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"__{other}s") - 1)))
        .drop("__block", f"__{other}s")
    )


def _level(low: str, high: str, width: float) -> Column:
    """The level whose cells, ``width`` times a power of four, are at least as wide as a range; the last one if they have no numbers."""
    size = (F.col(high) - F.col(low)) / width
    exact = (F.greatest(F.abs(F.col(low)), F.abs(F.col(high))) / width) < float(1 << 52)
    return F.when(exact, F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1.0))) / 2)).cast("int")).otherwise(_OPEN_LEVEL)


def _cell(width: float) -> Column:
    return width * F.pow(F.lit(4.0), F.col("__level"))


def _levels(ranges: DataFrame, low: str, high: str, width: float) -> list[int]:
    """The levels that ranges have, about 30 at most."""
    return sorted(r[0] for r in ranges.select(_level(low, high, width)).distinct().collect())


def _place(ranges: DataFrame, low: str, high: str, width: float, levels: list[int], others: list[int]) -> DataFrame:
    """A row for each cell of a range: at its own level (``__own``), if ranges as wide or narrower wait there, and at all higher ones of the other side.

    ``__first`` marks the cell in which the range begins; ranges without numbered cells begin in the one they share.
    """
    def meets(n: Column) -> Column:
        lower = (n == F.col("__least")) & (n > min(others)) if others else F.lit(False)
        return (n >= F.col("__least")) & (n.isin(others) | lower)

    every = F.array(*[F.lit(n) for n in sorted({*levels, *others})]).cast("array<int>")
    begin, end = (F.floor(F.col(n) / _cell(_ROOM * width)) for n in (low, high))
    open_level = F.col("__level") == _OPEN_LEVEL
    open_cell = F.array(F.lit(0).cast("bigint"))
    return (
        ranges.withColumn("__least", _level(low, high, width))
        .withColumn("__level", F.explode(F.filter(every, meets)))
        .withColumn("__own", F.col("__level") == F.col("__least"))
        .withColumn("__bucket", F.explode(F.when(open_level, open_cell).otherwise(F.sequence(begin, end))))
        .withColumn("__first", open_level | (F.col("__bucket") == begin))
        .drop("__least")
    )


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    before_seconds: int, after_seconds: int,
) -> DataFrame:
    """Left rows with right rows of the same key within ``[ts - before, ts + after]``.

    Time is cut into buckets as wide as the interval, so a hot key spreads over its buckets and
    each right row is copied to the two or three buckets whose left rows can reach it.
    """
    width = max(1, before_seconds + after_seconds) * 1_000_000
    micros_left, micros_right = _micros(F.col(left_ts)), _micros(F.col(right_ts))
    placed_left = left.withColumn("__bucket", F.floor(micros_left / width))
    placed_right = right.withColumn(
        "__bucket",
        F.explode(F.sequence(
            F.floor((micros_right - after_seconds * 1_000_000) / width),
            F.floor((micros_right + before_seconds * 1_000_000) / width),
        )),
    )
    gap = micros_right - micros_left
    return (
        placed_left.join(placed_right, [*keys, "__bucket"])
        .where((gap >= -before_seconds * 1_000_000) & (gap <= after_seconds * 1_000_000))
        .drop("__bucket")
    )


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def path_prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself: ``a/b/c`` gives ``a``, ``a/b``, ``a/b/c``."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def longest_prefix_join(
    paths: DataFrame, path: str, zones: DataFrame, zone: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Add the most specific zone that covers each path, and the zone's ``carry`` columns.

    A zone of ``d`` components can only match the first ``d`` components of a path, so each distinct
    path is spelled out at the depths that zones have and joined on equality.  Spark broadcasts a side
    by its measured size.  Paths outside every zone keep nulls.
    """
    stem = F.rtrim(F.col(zone), F.lit("/"))
    known = zones.where(F.col(zone).isNotNull()).groupBy(stem.alias("__stem")).agg(F.first(F.struct(zone, *carry)).alias("__zone")).withColumn(
        "__depth", F.size(F.split("__stem", "/"))
    )
    depths = [r["__depth"] for r in known.select("__depth").distinct().collect()]
    prefixes = F.array(*[F.substring_index(F.rtrim("__path", F.lit("/")), "/", d) for d in depths]).cast("array<string>")
    best = (
        paths.select(F.col(path).alias("__path")).distinct()
        .withColumn("__stem", F.explode(F.array_distinct(prefixes)))
        .join(known, "__stem")
        .groupBy("__path")
        .agg(F.max(F.struct("__depth", "__zone")).alias("__best"))
    )
    return paths.join(best, F.col(path) == F.col("__path"), "left").select(
        *[paths[c] for c in paths.columns], *[F.col("__best")["__zone"][c].alias(c) for c in (zone, *carry)]
    )


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key ...)`` with SQL's null rules, as a shuffled anti join.

    SQL returns no row at all if the list has a null, and drops null keys unless the list is empty.
    """
    listed = right.select(F.col(right_key).alias("__listed")).distinct()
    facts = right.agg(
        F.struct(
            F.count(F.lit(1)).alias("size"),
            F.count(F.when(F.col(right_key).isNull(), 1)).alias("nulls"),
        ).alias("facts")
    ).scalar()
    return left.join(listed, F.col(left_key) == F.col("__listed"), "left_anti").where(
        (facts["nulls"] == 0) & (F.col(left_key).isNotNull() | (facts["size"] == 0))
    )
