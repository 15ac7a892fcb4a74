"""Several groupings, and several distinct counts, without copying input rows for each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How parts of an aggregate make up the whole; counts are added up.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def grouping_sets(
    df: DataFrame, dimensions: Sequence[str], sets: Sequence[Sequence[str]], measures: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Measures for each of several groupings, and a flag ``g_<dimension>`` that is 1 where it is summed over.

    ``measures`` maps a name to ``(kind, column)`` with kind ``sum``, ``count`` (non-null values), ``min`` or ``max``.  The
    input is aggregated once, by all dimensions; the coarser sets are aggregates of that table, so only its rows are copied per
    set, and an input row is read and combined once.  An average is a sum over a count.  An empty
    input has no groups, not even the grand total.
    """
    dimensions = list(dimensions)
    first = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    finest = df.groupBy(*dimensions).agg(*[first[kind](column).alias(n) for n, (kind, column) in measures.items()])
    wanted = [[F.col(d) for d in s] for s in sets]
    coarse = finest.groupingSets(wanted, *[F.col(d) for d in dimensions])
    return coarse.agg(
        *[_MERGE[kind](F.col(n)).alias(n) for n, (kind, _) in measures.items()],
        *[F.grouping(d).cast("bigint").alias(f"g_{d}") for d in dimensions],
    )


def cube_sets(dimensions: Sequence[str]) -> list[list[str]]:
    """All subsets of the dimensions."""
    return reduce(lambda sets, d: sets + [[*s, d] for s in sets], dimensions, [[]])


def rollup_sets(dimensions: Sequence[str]) -> list[list[str]]:
    return [list(dimensions[:i]) for i in range(len(dimensions), -1, -1)]


def distinct_aggregates(
    df: DataFrame, keys: Sequence[str], distinct: Mapping[str, tuple[str, str]], plain: Mapping[str, Column]
) -> DataFrame:
    """Aggregates over distinct values of several columns, and plain ones, per key.

    ``distinct`` maps a name to ``(kind, column)`` with kind ``count`` or ``sum``.  Spark would copy every input row
    once per distinct column before it can combine any.  Here each column is reduced to its distinct values
    per key by an aggregate of its own, which reads that column only and combines before the shuffle, and
    the small results per key are joined.  A key of any size is spread by its values.  Nulls are not counted.
    """
    keys = list(keys)
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in plain.items()], F.count(F.lit(1)).alias("__rows"))
    for column in dict.fromkeys(c for _, c in distinct.values()):
        values = df.select(*keys, F.col(column).alias("__value")).where(F.col("__value").isNotNull()).distinct()
        mine = {n: kind for n, (kind, c) in distinct.items() if c == column}
        aggs = [(F.count(F.lit(1)) if kind == "count" else F.sum("__value")).alias(n) for n, kind in mine.items()]
        found = values.groupBy(*keys).agg(*aggs).withColumnsRenamed({k: f"__k_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys))
        out = out.join(found, same, "left").drop(*[f"__k_{k}" for k in keys])
        out = out.na.fill(0, [n for n, kind in mine.items() if kind == "count"])
    return out.drop("__rows")
