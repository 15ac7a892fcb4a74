"""Multiset operations by counting, with the copies of a frequent row written by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = 100_000


def _counted(left: DataFrame, right: DataFrame, copies: Column) -> DataFrame:
    names = left.columns
    tagged = left.select("*", F.lit(1).alias("__l"), F.lit(0).alias("__r")).union(
        right.select("*", F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    counted = (
        tagged.groupBy(*names)
        .agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
        .withColumn("__copies", copies)
        .where("__copies > 0")
    )
    pieces = counted.withColumn(
        "__piece", F.explode(F.sequence(F.lit(0), F.expr(f"(__copies - 1) DIV {_PIECE}")))
    ).withColumn("__size", F.least(F.lit(_PIECE), F.col("__copies") - F.col("__piece") * _PIECE))
    return (
        pieces.repartition(*names, "__piece")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__size").cast("int"))))
        .select(*names)
    )


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as it occurs in both inputs."""
    return _counted(left, right, F.least("__l", "__r"))


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as it occurs in ``left`` more than in ``right``."""
    return _counted(left, right, F.col("__l") - F.col("__r"))
