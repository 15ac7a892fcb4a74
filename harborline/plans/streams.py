"""Streams over the ``events`` files, run until all data is read, with the batch result as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.plans.governance import LEASES_SQL, lease_requests, roles
from harborline.plans.registry import Tables, query
from harborline.plans.telemetry import BOUNDS
from harborline.session import new_folder
from harborline.sources.files import list_files
from harborline.streaming import jobs


SLICES = 4


def event_stream(t: Tables):
    """The events as a stream of several batches: slices of time, written one after the other.

    A batch takes as many files as the largest slice has, so state is carried from batch to batch.
    """
    path = new_folder(t.spark, "event-slices")
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    rows = t.events
    for i in range(SLICES):
        if i == SLICES - 1 or low is None:
            rows.write.mode("append").parquet(path)
            break
        end = F.lit((low + (high - low) * (i + 1) / SLICES).isoformat(sep=" ")).cast("timestamp_ntz")
        rows.where(F.col("ts") < end).write.mode("append").parquet(path)
        rows = rows.where((F.col("ts") >= end) | F.col("ts").isNull())
    share = max(1, -(-list_files(t.spark, path, "*.parquet").count() // SLICES))
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", share).parquet(path)


def point_stream(t: Tables):
    return event_stream(t).select(F.col("event_type").alias("key"), "value", "ts", F.col("event_id").alias("id"))


@query("x1_stream_append_points", "SELECT event_type AS key, value, ts, event_id AS id FROM events")
def x1_stream_append_points(t: Tables):
    path = new_folder(t.spark, "x1")
    jobs.stream_append_points(point_stream(t), f"{path}/points", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/points")


@query(
    "x2_stream_retain_last_n",
    """
    SELECT key, value, ts, id FROM (
        SELECT event_type AS key, value, ts, event_id AS id,
               row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn <= 720
    """,
)
def x2_stream_retain_last_n(t: Tables):
    path = new_folder(t.spark, "x2")
    jobs.stream_retain_last_n(point_stream(t), f"{path}/checkpoint").awaitTermination()
    return jobs.retained_points(t.spark, f"{path}/checkpoint")


@query(
    "x3_stream_counters_histogram",
    """
    SELECT label, le, count(CASE WHEN value <= bound THEN 1 END) AS cumulative, count(*) AS total_count
    FROM (SELECT event_type AS label, value FROM events WHERE value IS NOT NULL),
         (VALUES ('1', 1.0), ('10', 10.0), ('100', 100.0), ('+Inf', 1e300)) AS b(le, bound)
    GROUP BY label, le
    """,
)
def x3_stream_counters_histogram(t: Tables):
    path = new_folder(t.spark, "x3")
    jobs.stream_counters_histogram(
        event_stream(t), f"{path}/histogram", f"{path}/checkpoint", "event_type", "value", BOUNDS
    ).awaitTermination()
    return jobs.current_histogram(t.spark, f"{path}/histogram", BOUNDS).select("label", "le", "cumulative", "total_count")


@query(
    "x4_stream_lease_expiry",
    f"SELECT lease_id, role, expire_time FROM ({LEASES_SQL}) WHERE expire_time <= (SELECT max(ts) FROM events)",
)
def x4_stream_lease_expiry(t: Tables):
    path = new_folder(t.spark, "x4")
    jobs.stream_lease_expiry(
        lease_requests(event_stream(t)), roles(t), path, f"{path}/checkpoint"
    ).awaitTermination()
    return jobs.expired_leases(t.spark, path).select("lease_id", "role", "expire_time")


@query(
    "x5_stream_tumbling_stats",
    """
    SELECT window_start, key, points, avg_value FROM (
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS points,
               round(avg(value), 9) AS avg_value FROM events GROUP BY ALL)
    WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
    """,
)
def x5_stream_tumbling_stats(t: Tables):
    """Windows the watermark has closed; later ones are still open when the input ends."""
    path = new_folder(t.spark, "x5")
    jobs.stream_tumbling_stats(
        point_stream(t), f"{path}/stats", f"{path}/checkpoint", "1 hour", "10 minutes"
    ).awaitTermination()
    return t.spark.read.parquet(f"{path}/stats").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "key", "points",
        F.round("avg_value", 9).alias("avg_value"),
    )
