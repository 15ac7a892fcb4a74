"""Metric series, annotations, counters, gauges and histograms over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import annotations as notes
from harborline.operators import governance, metrics, series
from harborline.operators.lake import compaction_groups
from harborline.operators.sql import query_log_metrics
from harborline.plans.encryption import KEYS_SQL, REWRAPPED_SQL, ZONE, order_keys, rewraps, rolled_keys
from harborline.plans.governance import LEASES_SQL, NOW, TICKETS_SQL, current_tickets, leases
from harborline.plans.lake import CLEANUP_SQL, event_snapshots, l9_cleanup_by_table, order_files
from harborline.plans.registry import Tables, query
from harborline.session import literal_table, new_folder


def points(t: Tables):
    return t.events.select(
        F.col("event_type").alias("key"), "value", "ts", F.col("event_id").alias("id")
    )


@query(
    "q3_query_log_metrics",
    """
    SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS queries_total,
           count(CASE WHEN event_type <> 'error' THEN 1 END) AS observed,
           round(coalesce(sum(CASE WHEN event_type <> 'error' THEN value / 100 END), 0), 4) AS duration_sum,
           CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN user_id END), 0) AS BIGINT) AS rows_total
    FROM events GROUP BY 1
    """,
)
def q3_query_log_metrics(t: Tables):
    log = t.events.select(
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (F.col("value") / 100).alias("duration_secs"), F.col("user_id").alias("row_count"),
    )
    return query_log_metrics(log).withColumn("duration_sum", F.round("duration_sum", 4))


@query("t1_append_points", "SELECT event_type AS key, value, ts, event_id AS id FROM events")
def t1_append_points(t: Tables):
    path = new_folder(t.spark, "points")
    part = F.coalesce(F.col("id"), F.lit(0)) % 2
    for i in (0, 1):
        series.append_points(points(t).where(part == i), path)
    return t.spark.read.parquet(path)


@query(
    "t2_retain_last_n",
    """
    SELECT key, value, ts, id FROM (
        SELECT event_type AS key, value, ts, event_id AS id,
               row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn <= 720
    """,
)
def t2_retain_last_n(t: Tables):
    return series.retain_last_n(points(t))


@query("t3_list_metrics", "SELECT DISTINCT event_type AS key FROM events")
def t3_list_metrics(t: Tables):
    return series.list_metrics(points(t))


@query(
    "t4_query_series",
    """
    SELECT CAST(pos AS BIGINT) AS pos, target, ts, value
    FROM (VALUES (0, 'view'), (1, 'absent'), (2, 'click'), (3, 'view')) AS v(pos, target)
    LEFT JOIN events ON event_type = target
    """,
)
def t4_query_series(t: Tables):
    return series.query_series(t.spark, points(t), ["view", "absent", "click", "view"])


@query(
    "t5_series_summary",
    """
    SELECT event_type AS key, arg_max(value, ts) AS latest, min(value) AS min_value, max(value) AS max_value,
           count(*) AS points FROM events GROUP BY event_type
    """,
)
def t5_series_summary(t: Tables):
    return series.series_summary(points(t))


@query(
    "t6_scale_series",
    """
    SELECT event_type AS key, event_id AS id, CAST(i - 1 AS BIGINT) AS point_index,
           round(20 + (CASE WHEN n > 1 THEN (i - 1) / (n - 1) ELSE 0 END) * 760, 6) AS x,
           round(160 - 20 - (value - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 120, 6) AS y
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i,
                 count(*) OVER (PARTITION BY event_type) AS n, min(value) OVER (PARTITION BY event_type) AS lo,
                 max(value) OVER (PARTITION BY event_type) AS hi FROM events)
    """,
)
def t6_scale_series(t: Tables):
    scaled = series.scale_series(points(t))
    return scaled.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_MERGES = """
SELECT o_orderdate AS time, 'Partition Compaction' AS title,
       'Merged ' || count(*) || ' small files' AS text, 'lake,compaction' AS tags
FROM orders WHERE floor(o_totalprice) < 100000 GROUP BY o_orderdate HAVING count(*) >= 2
"""


def _merge_annotations(t: Tables):
    groups = compaction_groups(order_files(t), threshold=100_000, target=250_000)
    return notes.of_compaction(groups, F.col("dt"))


@query("t7_append_annotation", _MERGES)
def t7_append_annotation(t: Tables):
    path = new_folder(t.spark, "annotations")
    series.append_annotations(_merge_annotations(t), path)
    return t.spark.read.parquet(path).withColumn("tags", F.array_join("tags", ","))


_CHECKED = "2024-01-31"
_OPERATIONS = f"""
SELECT ts AS time, 'Snapshot Commit' AS title, user_id || ': append with ' || 1 || ' records in ' || 1 || ' files' AS text, 'lake,commit' AS tags
FROM events
UNION ALL
SELECT TIMESTAMP '{_CHECKED}', 'Orphan Purge', 'Reclaimed ' || reclaimed_bytes || ' bytes in ' || orphan_files || ' files, '
       || expired_snapshots || ' snapshots expired', 'lake,cleanup'
FROM ({CLEANUP_SQL}) WHERE orphan_files > 0 OR expired_snapshots > 0
UNION ALL
SELECT issue_time, 'Credential Issued', 'Lease ' || lease_id || ' for role ' || role || ', ' || ttl_secs || ' seconds', 'lease,issue' FROM ({LEASES_SQL})
UNION ALL
SELECT expire_time, 'Credential Expired', 'Lease ' || lease_id || ' for role ' || role, 'lease,expiry'
FROM ({LEASES_SQL}) WHERE expire_time <= TIMESTAMP '{NOW}'
UNION ALL
SELECT TIMESTAMP '{_CHECKED}', 'Credential Revoked', 'Lease ' || o_orderkey, 'lease,revocation'
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL
SELECT TIMESTAMP '{_CHECKED}', 'Master Key Rolled', 'Key ' || key_name || ' has version v' || (count(*) + 1), 'keys,roll'
FROM ({KEYS_SQL}) GROUP BY key_name
UNION ALL
SELECT TIMESTAMP '{_CHECKED}', 'Data Keys Rewrapped', count(*) || ' data keys below {ZONE} moved to v' || latest || ' of ' || key_name, 'keys,rewrap'
FROM ({REWRAPPED_SQL}) WHERE rewrapped GROUP BY key_name, latest
UNION ALL
SELECT start_time, 'Ticket Issued', server || ' for ' || client || ' until ' || strftime(end_time, '%Y-%m-%d %H:%M:%S'), 'ticket' FROM ({TICKETS_SQL})
"""


@query("t7_operation_annotations", _OPERATIONS)
def t7_operation_annotations(t: Tables):
    """What commits, clean-ups, leases, keys and tickets leave in the log of annotations."""
    time = F.expr(f"TIMESTAMP_NTZ '{_CHECKED}'")
    commits = event_snapshots(t).select(
        F.col("table_name").cast("string").alias("table_name"), "committed_at", F.lit("append").alias("operation"),
        F.lit(1).cast("bigint").alias("added_records"), F.lit(1).cast("bigint").alias("added_data_files"),
    )
    issued, keys = leases(t), order_keys(t)
    ended = governance.expire_leases(issued, F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    revoked = t.orders.select(F.col("o_orderkey").alias("lease_id")).join(
        t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("lease_id")), "lease_id", "left_semi"
    )
    made = [
        notes.of_snapshots(commits), notes.of_cleanup(l9_cleanup_by_table(t), time), notes.of_leases(issued), notes.of_expired_leases(ended),
        notes.of_revocations(revoked, time), notes.of_rolled_keys(rolled_keys(t, keys, time)), notes.of_rewraps(rewraps(t, keys), time),
        notes.of_tickets(current_tickets(t)),
    ]
    path = new_folder(t.spark, "operations")
    for rows in made:
        series.append_annotations(rows, path)
    return t.spark.read.parquet(path).withColumn("tags", F.array_join("tags", ","))


@query("t8_get_annotations", _MERGES)
def t8_get_annotations(t: Tables):
    other = series.annotations(
        t.events.where("event_type = 'signup'"), F.col("ts"), F.lit("Signup"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")), F.array(F.lit("access")),
    )
    found = series.get_annotations(_merge_annotations(t).unionByName(other), tag="compaction")
    return found.withColumn("tags", F.array_join("tags", ","))


@query(
    "t9_range_and_bin",
    """
    SELECT event_type AS key, time_bucket(INTERVAL 5 MINUTE, ts) AS bin_start, round(avg(value), 9) AS avg_value,
           min(value) AS min_value, max(value) AS max_value, count(*) AS points
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL
    """,
)
def t9_range_and_bin(t: Tables):
    start, end = F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-20'")
    binned = series.range_and_bin(points(t), start, end, "5 minutes")
    return binned.withColumn("avg_value", F.round("avg_value", 9))


@query("m1_labelled_counter", "SELECT event_type AS label, count(*) AS total FROM events GROUP BY event_type")
def m1_labelled_counter(t: Tables):
    return metrics.labelled_counter(t.events, "event_type")


BOUNDS = (1.0, 10.0, 100.0)


@query(
    "m2_cumulative_histogram",
    """
    SELECT label, CAST(le_index AS BIGINT) AS le_index, le, count(CASE WHEN value <= bound THEN 1 END) AS cumulative,
           count(*) AS total_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_sum
    FROM (SELECT event_type AS label, value FROM events WHERE value IS NOT NULL),
         (VALUES (0, '1', 1.0), (1, '10', 10.0), (2, '100', 100.0), (3, '+Inf', CAST('inf' AS DOUBLE))) AS b(le_index, le, bound)
    GROUP BY label, le_index, le
    """,
)
def m2_cumulative_histogram(t: Tables):
    exact = t.events.withColumn("value", F.col("value").cast("decimal(18,2)"))
    found = metrics.cumulative_histogram(exact, "event_type", "value", BOUNDS)
    return found.select(
        "label", F.col("le_index").cast("bigint").alias("le_index"), "le", "cumulative", "total_count",
        F.col("total_sum").cast("double").alias("total_sum"),
    )


@query(
    "m2_duration_histogram",
    """
    SELECT label, le, count(CASE WHEN secs <= bound THEN 1 END) AS cumulative
    FROM (SELECT event_type AS label, value / 100 AS secs FROM events),
         (VALUES ('0.001', 0.001), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1),
                 ('0.25', 0.25), ('0.5', 0.5), ('1', 1.0), ('2.5', 2.5), ('+Inf', 1e300)) AS b(le, bound)
    GROUP BY label, le
    """,
)
def m2_duration_histogram(t: Tables):
    seconds = t.events.withColumn("secs", F.col("value") / 100)
    return metrics.cumulative_histogram(seconds, "event_type", "secs").select("label", "le", "cumulative")


@query("m3_total", "SELECT CAST(sum(user_id) AS BIGINT) AS total FROM events")
def m3_total(t: Tables):
    return metrics.total(t.events, "user_id")


@query("m4_gauge_last", "SELECT event_type AS key, arg_max(value, ts) AS gauge FROM events GROUP BY event_type")
def m4_gauge_last(t: Tables):
    return metrics.gauge_last(t.events, "event_type", "value", "ts", "event_id")


@query(
    "m4_gauge_net",
    """
    SELECT user_id AS key, CAST(sum(CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'signup' THEN 2 ELSE 1 END) AS BIGINT) AS gauge
    FROM events GROUP BY user_id
    """,
)
def m4_gauge_net(t: Tables):
    kind = F.col("event_type")
    return metrics.gauge_net(
        t.events, "user_id", F.when(kind == "error", -1).when(kind == "signup", 2).otherwise(1)
    )


@query(
    "m5_exposition_lines",
    """
    SELECT 'events_total{type="' || event_type || '",user="' || user_id || '"} ' || count(*) AS line
    FROM events GROUP BY event_type, user_id
    """,
)
def m5_exposition_lines(t: Tables):
    counted = t.events.groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("user")).count()
    return metrics.exposition_lines(counted, "events_total", ["type", "user"], "count")


@query(
    "m5_exposition_histogram",
    """
    WITH v AS (SELECT coalesce(event_type, '') AS label, CAST(floor(value) AS BIGINT) AS value FROM events WHERE value IS NOT NULL)
    SELECT 'event_value_bucket{type="' || label || '",le="' || le || '"} ' || count(*) FILTER (value <= bound) AS line
    FROM v, (VALUES ('1', 1.0), ('10', 10.0), ('100', 100.0), ('+Inf', 1e300)) AS b(le, bound) GROUP BY label, le
    UNION ALL SELECT 'event_value_sum{type="' || label || '"} ' || sum(value) FROM v GROUP BY label
    UNION ALL SELECT 'event_value_count{type="' || label || '"} ' || count(*) FROM v GROUP BY label
    UNION ALL VALUES ('# HELP event_value Value of an event.'), ('# TYPE event_value histogram')
    """,
)
def m5_exposition_histogram(t: Tables):
    values = t.events.select("event_type", F.floor("value").alias("value"))
    lines = metrics.exposition_histogram(metrics.cumulative_histogram(values, "event_type", "value", BOUNDS), "event_value", "type")
    header = metrics.exposition_header("event_value", "histogram", "Value of an event.")
    return lines.union(literal_table(t.spark, [(h,) for h in header], "line string"))
