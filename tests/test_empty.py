"""Operators on empty tables give empty results with their columns, not errors."""

import datetime as dt

from pyspark.sql import functions as F

from harborline.operators import maintenance, metrics, series
from harborline.operators.joins import interval_join, range_join
from harborline.operators.ordered import asof_join, peer_ranks, rows_frame, running, trailing_extrema, trailing_sum
from harborline.operators.quantiles import exact_quantiles
from harborline.operators.topn import latest_per_key, newest_per_key
from harborline.session import literal_table


def empty(events):
    return events.where("event_id < 0")


def test_ordered_operators(events):
    e = empty(events)
    assert running(e, ["user_id"], ["ts"], {"n": ("count", F.lit(1))}, 0).isEmpty()
    assert running(e, [], ["ts"], {"n": ("count", F.lit(1))}).columns == [*e.columns, "n"]
    assert rows_frame(e, ["user_id"], ["ts"], 1, 1, {"m": lambda w: F.max("value").over(w)}).isEmpty()
    assert peer_ranks(e, ["user_id"], ["value"]).isEmpty()
    assert trailing_extrema(e, ["user_id"], "ts", 60, F.col("value"), "low", "high").columns == [*e.columns, "low", "high"]
    assert exact_quantiles(e, ["user_id"], "value", {"q": 0.5}).isEmpty()
    assert trailing_sum(e, ["user_id"], "ts", 60, F.col("event_id"), "s", "c").isEmpty()
    assert newest_per_key(e, ["user_id"], ["ts"], 3).isEmpty()
    assert latest_per_key(e, "user_id", "ts", "event_id", "value").columns == ["user_id", "latest"]


def test_joins(events):
    e = empty(events).select("user_id", "ts")
    left = events.select("user_id", F.col("ts").alias("lts"), "event_id")
    assert interval_join(left, e, ["user_id"], "lts", "ts", 1, 1).isEmpty()
    assert range_join(events, e.selectExpr("1D AS lo", "2D AS hi"), "value", "lo", "hi", 1.0).isEmpty()
    found = asof_join(left, e.withColumnRenamed("ts", "rts"), ["user_id"], "lts", "rts", ["rts"])
    assert found.where("rts IS NULL").count() == events.count()


def test_series_and_metrics(spark, events):
    points = empty(events).select(F.col("event_type").alias("key"), "value", "ts", F.col("event_id").alias("id"))
    assert series.scale_series(points).isEmpty() and series.series_summary(points).isEmpty()
    assert series.query_series(spark, points, ["a"]).count() == 1
    assert metrics.cumulative_histogram(empty(events), "event_type", "value").isEmpty()


def test_lake(spark, folder, events):
    rows = events.withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
    maintenance.append_rows(rows.where("event_id < 0"), folder)
    files = maintenance.table_files(spark, folder)
    assert files.isEmpty() and maintenance.read_files(spark, folder, files, rows.schema).isEmpty()
    assert maintenance.compact_partitions(spark, folder, files, rows.schema).isEmpty()
    none = [literal_table(spark, [], schema) for schema in (maintenance.SNAPSHOT_SCHEMA, maintenance.MANIFEST_SCHEMA)]
    done = maintenance.clean_up(spark, folder, *none, "t", 1, dt.datetime(2024, 2, 1))
    assert done.outcomes.isEmpty() and done.report.isEmpty()
