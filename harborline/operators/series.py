"""Metric series as a long table ``(key, value, ts, id)`` and annotations on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.ordered import MAX_GROUP_ROWS, running
from harborline.operators.topn import latest_per_key, newest_per_key
from harborline.session import literal_table

# Points kept per series; drawing area width, height and padding.
RETAINED_POINTS = 720
CHART_WIDTH, CHART_HEIGHT, CHART_PADDING = 800, 160, 20


def append_points(points: DataFrame, path: str) -> None:
    """Append points; a key needs no prior declaration."""
    points.select("key", "value", "ts", "id").write.mode("append").parquet(path)


def retain_last_n(points: DataFrame, n: int = RETAINED_POINTS) -> DataFrame:
    return newest_per_key(points, ["key"], ["ts", "id"], n)


def list_metrics(points: DataFrame) -> DataFrame:
    return points.select("key").distinct()


def query_series(spark: SparkSession, points: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Points of the requested keys in request order; duplicates repeat, unknown keys give no point.

    The result is long: one row per point, and one row with null ``value`` for an unknown key.
    The target list is the caller's own argument, so the join side holds just those names.
    """
    wanted = literal_table(spark, list(enumerate(targets)), "pos bigint, target string")
    found = wanted.join(points, F.col("target") == F.col("key"), "left")
    return found.select("pos", "target", "ts", "value")


def series_summary(points: DataFrame) -> DataFrame:
    return latest_per_key(
        points, "key", "ts", "id", "value",
        [F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("points")],
    )


def scale_series(points: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Chart coordinates per point: position across, value upwards.

    A single point sits at the left edge, and a flat series is drawn with a range of 1.
    """
    placed = running(
        points, ["key"], ["ts", "id"],
        {"idx": ("count", F.lit(1)), "__n": ("group_count", F.lit(1)),
         "__min": ("group_min", F.col("value")), "__max": ("group_max", F.col("value"))},
        max_group_rows,
    )
    spread = F.col("__max") - F.col("__min")
    share = F.when(F.col("__n") > 1, (F.col("idx") - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    level = (F.col("value") - F.col("__min")) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    inner_width = CHART_WIDTH - 2 * CHART_PADDING
    inner_height = CHART_HEIGHT - 2 * CHART_PADDING
    return placed.select(
        "key", "id", (F.col("idx") - 1).alias("point_index"),
        (F.lit(CHART_PADDING) + share * inner_width).alias("x"),
        (F.lit(CHART_HEIGHT - CHART_PADDING) - level * inner_height).alias("y"),
    )


def range_and_bin(points: DataFrame, start: Column, end: Column, interval: str) -> DataFrame:
    """Average, minimum, maximum and count per key and time bin for ``start <= ts < end``."""
    return (
        points.where((F.col("ts") >= start) & (F.col("ts") < end))
        .groupBy("key", F.window("ts", interval).alias("bin"))
        .agg(
            F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count(F.lit(1)).alias("points"),
        )
        .select("key", F.col("bin.start").alias("bin_start"), "avg_value", "min_value", "max_value", "points")
    )


def annotations(source: DataFrame, ts: Column, title: Column, text: Column, tags: Column) -> DataFrame:
    """Annotation rows made from the rows of an operation report."""
    return source.select(
        ts.alias("time"), title.alias("title"), text.alias("text"), tags.alias("tags")
    )


def append_annotations(rows: DataFrame, path: str) -> None:
    rows.select("time", "title", "text", "tags").write.mode("append").parquet(path)


def get_annotations(rows: DataFrame, tag: str | None = None) -> DataFrame:
    """Annotations in time order, optionally only those carrying ``tag``."""
    chosen = rows if tag is None else rows.where(F.array_contains("tags", tag))
    return chosen.orderBy("time", "title", "text")
