"""Newest rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import stage


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int, salts: int = 64
) -> DataFrame:
    """The last ``n`` rows of each key by ``order_by``, exact under any key skew.

    A tree of three cuts.  Each input task keeps its own newest ``n`` rows per key before the
    shuffle.  The survivors of a key meet in up to ``salts`` groups of input tasks, each cut to
    ``n`` again, so that the last step sees at most ``n * salts`` rows of a key however many tasks
    read it.
    """
    keys = list(keys)
    newest_first = [F.col(c).desc() for c in order_by]
    salted = df.withColumn("__salt", F.spark_partition_id() % salts)
    partial = (
        salted.withColumn(
            "__rn", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*newest_first))
        )
        .where(F.col("__rn") <= n)
        .drop("__rn", "__salt")
    )
    return (
        partial.withColumn(
            "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
        )
        .where(F.col("__rn") <= n)
        .drop("__rn")
    )


def latest_per_key(
    df: DataFrame, key: str, ts: str, tie: str, value: str, aggs: Sequence[Column] = ()
) -> DataFrame:
    """``key``, the ``value`` of its last row by ``(ts, tie)`` as ``latest``, and further ``aggs``.

    Ordering an aggregate by a pair makes Spark sort the whole input.  So the last time per key is
    hashed first, together with ``aggs``; then only rows at these times, mostly one per key, compete
    by ``tie``.  The second scan starts at the earliest of the last times, which skips older row
    groups of time-ordered files.
    """
    ends = stage(df.groupBy(key).agg(F.max(ts).alias("__last"), *aggs), "ends")
    since = ends.agg(F.min("__last")).scalar()
    candidates = df.select(key, ts, tie, value).where(F.col(ts) >= since)
    last = ends.select(F.col(key).alias("__key"), "__last")
    winners = (
        candidates.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col(ts) == F.col("__last")))
        .groupBy("__key").agg(F.max_by(value, tie).alias("latest"))
    )
    return ends.join(winners, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key", "__last")
