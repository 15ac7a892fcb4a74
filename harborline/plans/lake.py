"""Lake-table planning over mapped tables, and real appends, reads and compactions in fresh folders."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from harborline.operators import lake, maintenance
from harborline.plans.registry import Tables, query
from harborline.session import literal_table, new_folder, stage

NOW = dt.datetime(2024, 1, 31)


def event_snapshots(t: Tables):
    return t.events.select(
        F.col("user_id").alias("table_name"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("committed_at"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("manifest_list"),
    )


def order_files(t: Tables):
    return t.orders.select(
        F.col("o_orderstatus").alias("table_name"), F.col("o_orderkey").alias("file_path"),
        F.floor("o_totalprice").alias("file_size"), F.col("o_orderdate").alias("dt"),
    ).withColumn("table_name", F.lit("orders"))


def classified(t: Tables):
    return lake.classify_snapshots(event_snapshots(t), 3, F.expr("TIMESTAMP_NTZ '2024-01-24'"))


def orphans(t: Tables):
    listed = order_files(t).select(F.col("file_path").alias("path"), F.col("file_size").alias("length"))
    return lake.orphan_files(listed, t.lineitem.select(F.col("l_orderkey").alias("path")))


_CLASSIFIED = """
SELECT user_id, event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS manifest_list,
       coalesce(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 3
                AND ts < TIMESTAMP '2024-01-24', false) AS expired
FROM events
"""


@query("l1_list_tables", "SELECT DISTINCT user_id AS table_name FROM events")
def l1_list_tables(t: Tables):
    return lake.list_tables(event_snapshots(t))


@query(
    "l2_table_detail",
    """
    SELECT table_name, snapshot_id, l_linenumber AS file_number, l_quantity AS record_count FROM (
        SELECT o_custkey AS table_name, o_orderkey AS snapshot_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    LEFT JOIN lineitem ON l_orderkey = snapshot_id WHERE rn = 1
    """,
)
def l2_table_detail(t: Tables):
    snapshots = t.orders.select(
        F.col("o_custkey").alias("table_name"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("committed_at"),
    )
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("table_name"))
    files = t.lineitem.join(owners, "l_orderkey").select(
        "table_name", F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("file_number"),
        F.col("l_quantity").alias("record_count"),
    )
    return lake.table_detail(snapshots, files).drop("committed_at")


class EventTable:
    """Events in a partitioned folder, with snapshots and manifests as plain tables beside it."""

    name = "warehouse.events"

    def __init__(self, t: Tables):
        self.spark, self.base = t.spark, new_folder(t.spark, "lake")
        self.path = f"{self.base}/data"
        self.rows = t.events.withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
        self.schema = self.rows.schema

    def _read(self, part: str, schema: str):
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{part}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return literal_table(self.spark, [], schema)

    def snapshots(self):
        return self._read("snapshots", maintenance.SNAPSHOT_SCHEMA)

    def manifests(self):
        return self._read("manifests", maintenance.MANIFEST_SCHEMA)

    def commit(self, number: int, operation: str) -> None:
        """Note the files that are there now as snapshot ``number``; the snapshot's row comes last."""
        files = stage(maintenance.table_files(self.spark, self.path), "commit-files")
        parent = self.manifests().where(F.col("snapshot_id") == number - 1)
        row = maintenance.snapshot(files, parent, self.snapshots(), self.name, number, operation, NOW + dt.timedelta(days=number))
        maintenance.manifest(files, self.name, number).write.mode("append").parquet(f"{self.base}/manifests")
        row.write.mode("append").parquet(f"{self.base}/snapshots")

    def append(self, *conditions: str) -> EventTable:
        """One commit per condition on ``part``, the remainder of the event's number."""
        numbered = self.rows.withColumn("part", F.coalesce(F.col("event_id"), F.lit(0)) % len(conditions))
        for i, condition in enumerate(conditions):
            maintenance.append_rows(numbered.where(condition).drop("part"), self.path)
            self.commit(i + 1, "append")
        return self

    def files(self, number: int):
        return self.manifests().where(F.col("snapshot_id") == number)

    def read(self, number: int):
        return maintenance.read_files(self.spark, self.path, self.files(number), self.schema)

    def compact(self, number: int, **sizes: int):
        known = stage(maintenance.table_files(self.spark, self.path), "before")
        report = maintenance.compact_partitions(self.spark, self.path, known, self.schema, self.name, **sizes)
        self.commit(number, "replace")
        return report


@query(
    "l3_append_snapshot",
    """
    SELECT CAST(1 AS BIGINT) AS version, 'append' AS operation, count(*) AS added_records, true AS first_has_no_parent FROM events WHERE coalesce(event_id, 0) % 2 = 0
    UNION ALL
    SELECT 2, 'append', count(*), true FROM events WHERE coalesce(event_id, 0) % 2 = 1
    """,
)
def l3_append_snapshot(t: Tables):
    snapshots = EventTable(t).append("part = 0", "part = 1").snapshots()
    return snapshots.select(
        "version", "operation", "added_records",
        (F.col("parent_snapshot_id").isNull() == (F.col("version") == 1)).alias("first_has_no_parent"),
    )


@query(
    "l4_snapshot_summary",
    """
    SELECT l_orderkey AS snapshot_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added_records, count(*) AS added_data_files,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS summary_records
    FROM lineitem GROUP BY l_orderkey
    """,
)
def l4_snapshot_summary(t: Tables):
    files = t.lineitem.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_quantity").cast("bigint").alias("record_count"))
    return lake.snapshot_summary(files).select(
        "snapshot_id", "added_records", "added_data_files",
        F.element_at("summary", "added-records").alias("summary_records"),
    )


@query(
    "l5_read_snapshot",
    """
    SELECT CAST(1 AS BIGINT) AS version, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE coalesce(event_id, 0) % 2 = 0 GROUP BY event_type
    UNION ALL
    SELECT 2, event_type, count(*), CAST(sum(event_id) AS BIGINT) FROM events GROUP BY event_type
    """,
)
def l5_read_snapshot(t: Tables):
    events = EventTable(t).append("part = 0", "part = 1")

    def totals(number):
        return events.read(number).groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
        ).select(F.lit(number).cast("bigint").alias("version"), "event_type", "n", "ids")

    return totals(1).union(totals(2))


@query("l6_classify_snapshots", f"SELECT user_id AS table_name, event_id AS snapshot_id, expired FROM ({_CLASSIFIED})")
def l6_classify_snapshots(t: Tables):
    return classified(t).select("table_name", "snapshot_id", "expired")


@query(
    "l7_orphan_manifests",
    f"SELECT manifest_list FROM ({_CLASSIFIED}) GROUP BY manifest_list HAVING bool_and(expired)",
)
def l7_orphan_manifests(t: Tables):
    return lake.orphan_manifests(classified(t))


@query(
    "l8_orphan_files",
    """
    SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def l8_orphan_files(t: Tables):
    return orphans(t)


@query(
    "l9_cleanup_report",
    f"""
    SELECT count(*) FILTER (WHERE expired) AS expired_snapshots, count(*) FILTER (WHERE NOT expired) AS retained_snapshots,
           (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS orphan_files,
           (SELECT CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) FROM orders
            WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS reclaimed_bytes
    FROM ({_CLASSIFIED})
    """,
)
def l9_cleanup_report(t: Tables):
    return lake.cleanup_report(classified(t), orphans(t))


CLEANUP_SQL = f"""
WITH snapshots AS (
    SELECT user_id AS table_name, count(*) FILTER (WHERE expired) AS expired_snapshots,
           count(*) FILTER (WHERE NOT expired) AS retained_snapshots, max(event_id) AS metadata_version
    FROM ({_CLASSIFIED}) GROUP BY user_id),
manifests AS (
    SELECT user_id AS table_name, count(*) AS deleted_manifests FROM (
        SELECT user_id, manifest_list FROM ({_CLASSIFIED}) GROUP BY ALL HAVING bool_and(expired)) GROUP BY user_id),
files AS (
    SELECT o_custkey AS table_name, count(*) AS orphan_files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS reclaimed_bytes
    FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_custkey)
SELECT s.table_name, expired_snapshots, retained_snapshots, metadata_version, coalesce(orphan_files, 0) AS orphan_files,
       coalesce(reclaimed_bytes, 0) AS reclaimed_bytes, coalesce(deleted_manifests, 0) AS deleted_manifests
FROM snapshots s LEFT JOIN files f ON f.table_name IS NOT DISTINCT FROM s.table_name
LEFT JOIN manifests m ON m.table_name IS NOT DISTINCT FROM s.table_name
"""


@query("l9_cleanup_by_table", CLEANUP_SQL)
def l9_cleanup_by_table(t: Tables):
    """Users as tables: their events as snapshots, their orders without items as orphan files."""
    snapshots = classified(t).withColumn("version", F.col("snapshot_id"))
    lost = t.orders.select(F.col("o_custkey").alias("table_name"), F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("length"))
    unused = lake.orphan_files(lost, t.lineitem.select(F.col("l_orderkey").alias("path")))
    return lake.cleanup_by_table(snapshots, unused, lake.orphan_manifests_by_table(snapshots))


_SMALL = """
SELECT o_orderdate AS dt, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS b
FROM orders WHERE floor(o_totalprice) < 100000 GROUP BY o_orderdate HAVING count(*) >= 2
"""


@query(
    "l10_small_files",
    f"""
    SELECT o_orderkey AS file_path, CAST(floor(o_totalprice) AS BIGINT) AS file_size, o_orderdate AS dt,
           CAST(greatest(1, ceil(b / 250000.0)) AS BIGINT) AS bins
    FROM orders JOIN ({_SMALL}) ON dt IS NOT DISTINCT FROM o_orderdate WHERE floor(o_totalprice) < 100000
    """,
)
def l10_small_files(t: Tables):
    found = lake.small_files(order_files(t), threshold=100_000, target=250_000)
    return found.select("file_path", "file_size", "dt", F.col("bins").cast("bigint").alias("bins"))


@query(
    "l11_compact",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS files
    FROM events GROUP BY 1
    """,
)
def l11_compact(t: Tables):
    """Rows and files per partition after compacting three commits; every row is still there once."""
    events = EventTable(t).append("part = 0", "part = 1", "part = 2")
    events.compact(4)
    files = events.files(4).groupBy(F.col("dt").alias("file_dt")).agg(F.count(F.lit(1)).alias("files"))
    return events.read(4).groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
    ).join(files, F.col("dt").eqNullSafe(F.col("file_dt"))).drop("file_dt")


@query(
    "l12_compaction_report",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS dt, count(DISTINCT coalesce(event_id, 0) % 3) AS files_merged, CAST(1 AS BIGINT) AS new_files,
           true AS bytes_are_those_of_the_files
    FROM events GROUP BY 1
    """,
)
def l12_compaction_report(t: Tables):
    """Report over files really written; its bytes are compared with the files listed before and after."""
    events = EventTable(t).append("part = 0", "part = 1", "part = 2")
    report = events.compact(4)

    def bytes_in(number):
        return events.files(number).groupBy(F.col("dt").alias(f"dt{number}")).agg(F.sum("file_size").alias(f"bytes{number}"))

    both = report.join(bytes_in(3), F.col("dt").eqNullSafe(F.col("dt3"))).join(bytes_in(4), F.col("dt").eqNullSafe(F.col("dt4")))
    same = (F.col("original_bytes") == F.col("bytes3")) & (F.col("compacted_bytes") == F.col("bytes4"))
    return both.select("dt", "files_merged", "new_files", same.alias("bytes_are_those_of_the_files"))


@query(
    "l11_clean_after_compaction",
    """
    SELECT CAST(3 AS BIGINT) AS expired_snapshots, CAST(1 AS BIGINT) AS retained_snapshots, CAST(3 AS BIGINT) AS deleted_manifests,
           true AS only_inputs_deleted, count(*) AS rows_kept FROM events
    """,
)
def l11_clean_after_compaction(t: Tables):
    """Files and manifests of the snapshots before the compaction go, and no row goes with them."""
    events = EventTable(t).append("part = 0", "part = 1", "part = 2")
    merged = events.compact(4).agg(F.sum("files_merged")).first()[0]
    done = maintenance.clean_up(
        t.spark, events.path, events.snapshots(), events.manifests(), events.name, 1, NOW + dt.timedelta(days=8), apply=True
    )
    rows = t.spark.read.schema(events.schema).parquet(events.path).agg(F.count(F.lit(1)).alias("rows_kept"))
    return done.report.select(
        "expired_snapshots", "retained_snapshots", "deleted_manifests", (F.col("orphan_files") == merged).alias("only_inputs_deleted"),
        rows.scalar().alias("rows_kept"),
    )
