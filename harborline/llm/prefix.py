"""Prefix sums over a global order, without one task for a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.textio import same
from harborline.session import stage


def prefix_sums(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the group, in ``order``, nulls last.

    The rows are range-sorted by group and order, so a large group lies in many ranges.  Each range
    sums its own rows; a small table of sums per range gives what lies before a range.  The sorted
    rows are written once, because range bounds are sampled and must not change between the uses.
    Equal rows share a range.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*groups, *order)]
    ranged = stage(
        rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "prefix-sums"
    )
    cell = [*groups, "__range"]
    totals = ranged.groupBy(*cell).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cell, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*cell).orderBy(*keys[len(groups) :]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(starts, same(local, starts, cell)).select(
        *[local[c] for c in rows.columns], (F.col("__start") + F.col("__local")).alias(name)
    )
