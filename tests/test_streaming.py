"""A stream of several files, stopped and started again, ends with the batch result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.operators import governance, metrics, series
from harborline.plans.governance import lease_requests, roles
from harborline.plans.registry import Tables
from harborline.streaming import jobs
from harborline.session import literal_table
from tests.conftest import SF, same_rows

PARTS = 4


@pytest.fixture()
def source(spark, folder, events):
    """The events in time order as four files, of which the last comes later."""
    def write(part):
        size = events.count() // PARTS
        piece = events.where((F.col("event_id") >= part * size) & (F.col("event_id") < (part + 1) * size))
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    for part in range(PARTS - 1):
        write(part)
    return f"{folder}/in", lambda: write(PARTS - 1)


def stream(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def as_points(df):
    return df.select(F.col("event_type").alias("key"), "value", "ts", F.col("event_id").alias("id"))


def run_twice(start, add):
    for _ in range(2):
        query = start()
        query.awaitTermination()
        assert query.exception() is None
        add()
        add = lambda: None


def test_append(spark, events, source, folder):
    path, add = source
    run_twice(lambda: jobs.stream_append_points(as_points(stream(spark, events, path)), f"{folder}/out", f"{folder}/cp"), add)
    assert same_rows(spark.read.parquet(f"{folder}/out"), as_points(events))


def test_retention(spark, events, source, folder):
    path, add = source
    run_twice(lambda: jobs.stream_retain_last_n(as_points(stream(spark, events, path)), f"{folder}/cp", n=30), add)
    assert same_rows(jobs.retained_points(spark, f"{folder}/cp", 30), series.retain_last_n(as_points(events), 30))
    held = spark.read.format("statestore").option("stateVarName", "points").load(f"{folder}/cp")
    assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 30


def test_retention_with_nulls_and_ties(spark, folder):
    """Null keys, times and ids are kept by the batch operator's order, in any order of arrival."""
    kinds = "key string, value double, ts timestamp_ntz, id bigint"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, 5)
    rows = [("a", 1.0, at(3), 1), ("a", None, at(3), 2), ("a", 3.0, None, 3), (None, 4.0, at(1), None), (None, 5.0, at(2), 2**60 + 1), ("b", 6.0, None, None)]
    for part in (rows[3:], rows[:3]):
        literal_table(spark, part, kinds).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_retain_last_n(source, f"{folder}/cp", n=1).awaitTermination()
    assert same_rows(jobs.retained_points(spark, f"{folder}/cp", 1), series.retain_last_n(literal_table(spark, rows, kinds), 1))


def test_histogram(spark, events, source, folder):
    path, add = source
    bounds = [1.0, 10.0, 100.0]
    run_twice(lambda: jobs.stream_counters_histogram(
        stream(spark, events, path), f"{folder}/out", f"{folder}/cp", "event_type", "value", bounds), add)
    batch = metrics.cumulative_histogram(events, "event_type", "value", bounds)
    exact = lambda df: df.withColumn("total_sum", F.round("total_sum", 4))
    assert same_rows(exact(jobs.current_histogram(spark, f"{folder}/out", bounds)), exact(batch))


def test_lease_expiry(spark, events, source, folder):
    path, add = source
    t = Tables(spark, SF)
    run_twice(lambda: jobs.stream_lease_expiry(lease_requests(stream(spark, events, path)), roles(t), f"{folder}/out", f"{folder}/cp"), add)
    leases, _ = governance.issue_leases(lease_requests(events), roles(t))
    last = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    expected = governance.expire_leases(leases, last)
    assert same_rows(jobs.expired_leases(spark, f"{folder}/out").select(*expected.columns), expected)
    active = jobs.running_leases(spark, f"{folder}/cp")
    assert same_rows(active.select("lease_id"), leases.where(F.col("expire_time") > last).select("lease_id"))


def test_rejected_requests_move_the_clock(spark, folder):
    """A lease ends by the time of a later request, even if that request is refused and none runs any more."""
    kinds = "lease_id bigint, role string, requested_ttl bigint, issue_time timestamp_ntz"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for rows in ([(1, "r", 600, at(1))], [(2, "gone", 600, at(2))], [(3, "r", 600, at(1, 30)), (4, "gone", 1, at(1))], [(5, "r", 600, at(3))]):
        literal_table(spark, rows, kinds).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    known = literal_table(spark, [("r", "db", 60, 3600)], "role_name string, db_name string, default_ttl_secs bigint, max_ttl_secs bigint")
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_lease_expiry(source, known, f"{folder}/out", f"{folder}/cp").awaitTermination()
    ended = jobs.expired_leases(spark, f"{folder}/out")
    assert sorted(r["lease_id"] for r in ended.collect()) == [1, 3]
    assert [tuple(r) for r in jobs.running_leases(spark, f"{folder}/cp").collect()] == [(5, "r", "db", at(3), at(3, 10), 600)]


def test_lease_ends_at_the_millisecond(spark, folder):
    """A lease ending with the stream's time is over, one ending a millisecond later is not; copies and null ids count."""
    kinds = "lease_id bigint, role string, requested_ttl bigint, issue_time timestamp_ntz"
    at = lambda m, us=0: dt.datetime(2024, 1, 1, 1, m, 0, us)
    rows = [(2**60 + 1, "r", 60, at(0)), (2, "r", 60, at(0, 1000)), (None, "r", 60, at(0)), (None, "r", 60, at(0)), (4, "r", 60, None)]
    for part in (rows, [(9, "gone", 60, at(1))]):
        literal_table(spark, part, kinds).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    known = literal_table(spark, [("r", "db", 60, 3600)], "role_name string, db_name string, default_ttl_secs bigint, max_ttl_secs bigint")
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_lease_expiry(source, known, f"{folder}/out", f"{folder}/cp").awaitTermination()
    ended = [r["lease_id"] for r in jobs.expired_leases(spark, f"{folder}/out").collect()]
    assert sorted(ended, key=str) == [2**60 + 1, None, None]
    assert [r["lease_id"] for r in jobs.running_leases(spark, f"{folder}/cp").collect()] == [2]


def test_leases_share_state_keys(spark, folder, monkeypatch):
    """State keys follow the time that leases span, not their number; a key's leases end one by one, each once."""
    monkeypatch.setattr(jobs, "SALTS", 2)
    kinds = "lease_id bigint, role string, requested_ttl bigint, issue_time timestamp_ntz"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    parts = [[(i, "r", 60 + i % 120, at(0)) for i in range(300)], [(900, "gone", 1, at(59))], [(901, "r", 600, at(58)), (902, "gone", 1, dt.datetime(2024, 1, 1, 0, 2))]]
    for rows in parts:
        literal_table(spark, rows, kinds).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(kinds).parquet(f"{folder}/in")
        known = literal_table(spark, [("r", "db", 60, 3600)], "role_name string, db_name string, default_ttl_secs bigint, max_ttl_secs bigint")
        jobs.stream_lease_expiry(source, known, f"{folder}/out", f"{folder}/cp").awaitTermination()
    ended = [r["lease_id"] for r in jobs.expired_leases(spark, f"{folder}/out").collect()]
    assert sorted(ended) == [i for i in range(300) if 60 + i % 120 <= 120]
    running = jobs.running_leases(spark, f"{folder}/cp")
    assert sorted(r["lease_id"] for r in running.collect()) == [*(i for i in range(300) if 60 + i % 120 > 120), 901]
    held = spark.read.format("statestore").option("stateVarName", "leases").load(f"{folder}/cp")
    assert held.select("key").distinct().count() <= 4


def test_tumbling_windows(spark, events, source, folder):
    path, add = source
    run_twice(lambda: jobs.stream_tumbling_stats(
        as_points(stream(spark, events, path)), f"{folder}/out", f"{folder}/cp", "1 hour", "10 minutes"), add)
    emitted = spark.read.parquet(f"{folder}/out")
    closed = emitted.agg(F.max("window_end")).first()[0]
    batch = (
        events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), F.col("event_type").alias("key"))
        .agg(F.count(F.lit(1)).alias("points")).where(F.col("w.end") <= F.lit(closed))
        .select(F.col("w.start").alias("window_start"), "key", "points")
    )
    assert same_rows(emitted.select("window_start", "key", "points"), batch)
