"""Snapshots, compaction and clean-up: boundaries, invariants and real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.operators import lake, maintenance
from harborline.session import literal_table, stage
from tests.conftest import same_rows

NOW = dt.datetime(2024, 2, 1)
DAY = dt.timedelta(days=1)


def snapshots(spark, days):
    rows = [("t", i, NOW - DAY * d) for i, d in enumerate(days)]
    return literal_table(spark, rows, "table_name string, snapshot_id bigint, committed_at timestamp")


def expired_ids(df, n, cutoff):
    found = lake.classify_snapshots(df, n, F.lit(cutoff).cast("timestamp")).where("expired")
    return sorted(r["snapshot_id"] for r in found.collect())


def test_expiry_needs_both_age_and_position(spark):
    df = snapshots(spark, [10, 9, 8, 7, 6])
    assert expired_ids(df, 2, NOW - DAY * 7) == [0, 1, 2]
    assert expired_ids(df, 4, NOW - DAY * 7) == [0]
    assert expired_ids(df, 2, NOW - DAY * 30) == []
    assert expired_ids(df, 5, NOW) == []


def test_snapshot_at_the_cutoff_is_kept(spark):
    assert expired_ids(snapshots(spark, [7, 1, 0]), 1, NOW - DAY * 7) == []


def test_current_snapshot_is_kept_even_for_zero(spark):
    assert expired_ids(snapshots(spark, [9, 8]), 0, NOW) == [0]


def test_file_at_the_threshold_is_not_small(spark):
    rows = [("t", f"f{i}", size, "d") for i, size in enumerate([99, 100, 98])]
    files = literal_table(spark, rows, "table_name string, file_path string, file_size bigint, dt string")
    assert {r["file_path"] for r in lake.small_files(files, 100, 1000).collect()} == {"f0", "f2"}
    assert lake.small_files(files, 99, 1000).isEmpty()


def test_bins_follow_the_target(spark):
    rows = [("t", f"f{i}", 60, "d") for i in range(10)]
    files = literal_table(spark, rows, "table_name string, file_path string, file_size bigint, dt string")
    assert lake.compaction_groups(files, 100, 250).first()["bins"] == 3


@pytest.fixture()
def rows(events):
    """Partition values that need escaping in a path, one of them holding most rows."""
    day = F.when(F.col("event_id") % 4 > 0, "2024-01-01 10:00").otherwise(F.date_format("ts", "yyyy/MM/dd"))
    return events.withColumn("dt", day)


@pytest.fixture()
def table(spark, folder, rows):
    """Three appends, each a version with the files it added to the ones before."""
    path, versions = f"{folder}/data", []
    for i in range(3):
        maintenance.append_rows(rows.where(f"event_id % 3 = {i}"), path)
        versions.append(stage(maintenance.table_files(spark, path), "test-files"))
    return path, versions


def history(spark, versions, operations):
    """Snapshots and manifests of a table named ``t``, a day apart."""
    snapshots, manifests = literal_table(spark, [], maintenance.SNAPSHOT_SCHEMA), literal_table(spark, [], maintenance.MANIFEST_SCHEMA)
    for i, (files, operation) in enumerate(zip(versions, operations)):
        parent = manifests.where(F.col("snapshot_id") == i)
        row = maintenance.snapshot(files, parent, snapshots, "t", i + 1, operation, NOW + DAY * i)
        snapshots = stage(snapshots.unionByName(row), "test-snapshots")
        manifests = stage(manifests.unionByName(maintenance.manifest(files, "t", i + 1)), "test-manifests")
    return snapshots, manifests


def test_append_needs_a_partition_column(folder, events):
    with pytest.raises(ValueError):
        maintenance.append_rows(events, folder)


def test_missing_folder_has_no_files(spark, folder):
    assert maintenance.table_files(spark, f"{folder}/none").isEmpty()


def test_each_version_reads_its_rows(spark, table, rows):
    path, versions = table
    assert same_rows(maintenance.read_files(spark, path, versions[2], rows.schema), rows)
    assert same_rows(maintenance.read_files(spark, path, versions[0], rows.schema), rows.where("event_id % 3 = 0"))


def test_files_have_their_partitions_value(table, rows):
    _, versions = table
    counted = versions[2].groupBy("dt").agg(F.sum("record_count").alias("n"))
    assert same_rows(counted, rows.groupBy("dt").agg(F.count(F.lit(1)).alias("n")))


def test_escaped_and_missing_partition_values(spark, folder):
    kept = literal_table(spark, [(1, "a+b %2F/ü:"), (2, None), (3, "x=y")], "id bigint, dt string")
    for _ in range(2):
        maintenance.append_rows(kept.coalesce(1), folder)
    files = maintenance.table_files(spark, folder)
    assert {(r["dt"], r["n"]) for r in files.groupBy("dt").agg(F.sum("record_count").alias("n")).collect()} == {("a+b %2F/ü:", 2), (None, 2), ("x=y", 2)}
    report = maintenance.compact_partitions(spark, folder, files, kept.schema)
    assert {(r["dt"], r["files_merged"], r["new_files"]) for r in report.collect()} == {("a+b %2F/ü:", 2, 1), (None, 2, 1), ("x=y", 2, 1)}
    assert same_rows(spark.read.schema(kept.schema).parquet(folder), kept.union(kept))


def test_snapshot_rows(spark, table):
    _, versions = table
    snapshots, _ = history(spark, versions, ["append"] * 3)
    found = [(r["version"], r["parent_snapshot_id"]) for r in snapshots.orderBy("version").collect()]
    assert found == [(1, None), (2, 1), (3, 2)]
    added = versions[1].join(versions[0].select("file_path"), "file_path", "left_anti")
    second = snapshots.where("version = 2").first()
    assert (second["added_data_files"], second["added_records"]) == added.agg(F.count("*"), F.sum("record_count")).first()[0:2]


def test_compaction_keeps_rows_and_their_order(spark, table, rows):
    path, versions = table
    report = maintenance.compact_partitions(spark, path, versions[2], rows.schema, target=8_000)
    merged, made = report.agg(F.sum("files_merged"), F.sum("new_files")).first()
    assert merged > made
    hot = report.where("dt = '2024-01-01 10:00'").first()
    assert hot["new_files"] > 1, "a large partition is written as several files"
    now = spark.read.schema(rows.schema).parquet(path)
    assert same_rows(now, rows)
    listed = maintenance.table_files(spark, path)
    single = report.where("new_files = 1").select(F.col("dt").alias("d"))
    assert listed.join(single, F.col("dt").eqNullSafe(F.col("d"))).count() == single.count()
    place = now.select("dt", "event_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    # Within an output file, each input's rows stay in their order.
    runs = place.groupBy("f", (F.col("event_id") % 3).alias("input")).agg(F.sort_array(F.collect_list(F.struct("r", "event_id"))).alias("s"))
    for run in runs.collect():
        ids = [e["event_id"] for e in run["s"]]
        assert ids == sorted(ids)


def test_large_files_and_other_partitions_stay(spark, folder):
    """A file above the threshold gets a file of its own; partitions without two small files are not touched."""
    kinds = "id bigint, pad string, dt string"
    big = spark.range(20_000).selectExpr("id", "uuid() AS pad", "'a' AS dt")
    small = literal_table(spark, [(-1, "x", "a"), (-2, "y", "b")], kinds)
    for part in (big, small, small.where("id = -1")):
        maintenance.append_rows(part.coalesce(1), folder)
    files = stage(maintenance.table_files(spark, folder), "test-before")
    report = maintenance.compact_partitions(spark, folder, files, small.schema, threshold=100_000).collect()
    assert [(r["dt"], r["files_merged"], r["new_files"]) for r in report] == [("a", 3, 2)]
    after = maintenance.table_files(spark, folder)
    assert after.where("dt = 'b'").first()["file_path"] == files.where("dt = 'b'").first()["file_path"]
    assert sorted(r["record_count"] for r in after.where("dt = 'a'").collect()) == [2, 20_000]


def test_nothing_to_compact(spark, table, rows):
    path, versions = table
    assert maintenance.compact_partitions(spark, path, versions[2], rows.schema, threshold=1).isEmpty()
    assert same_rows(maintenance.table_files(spark, path).select("file_path"), versions[2].select("file_path"))


def test_clean_up_after_compaction(spark, table, rows):
    path, versions = table
    merged = maintenance.compact_partitions(spark, path, versions[2], rows.schema, "t").agg(F.sum("files_merged")).first()[0]
    now = stage(maintenance.table_files(spark, path), "test-now")
    snapshots, manifests = history(spark, [*versions, now], ["append"] * 3 + ["replace"])
    stray = spark.range(3).withColumn("dt", F.lit("2024-01-09")).coalesce(1)
    stray.write.mode("append").partitionBy("dt").parquet(path)

    dry = maintenance.clean_up(spark, path, snapshots, manifests, "t", 1, NOW + DAY * 9)
    assert {r["outcome"] for r in dry.outcomes.select("outcome").distinct().collect()} == {"planned"}
    done = maintenance.clean_up(spark, path, snapshots, manifests, "t", 1, NOW + DAY * 9, apply=True)
    report = done.report.first()
    assert (report["expired_snapshots"], report["retained_snapshots"], report["deleted_manifests"]) == (3, 1, 3)
    assert report["orphan_files"] == merged + 1
    outcomes = {r["outcome"]: r["count"] for r in done.outcomes.groupBy("outcome").count().collect()}
    assert outcomes == {"absent": merged, "deleted": 1}
    kept, files = maintenance.without_expired(snapshots, manifests, done.classified)
    assert [r["snapshot_id"] for r in kept.collect()] == [4]
    assert same_rows(files.select("file_path"), now.select("file_path"))
    assert same_rows(spark.read.schema(rows.schema).parquet(path), rows)


def test_files_of_a_retained_snapshot_survive(spark, table, rows):
    path, versions = table
    snapshots, manifests = history(spark, versions, ["append"] * 3)
    done = maintenance.clean_up(spark, path, snapshots, manifests, "t", 1, NOW + DAY * 9, apply=True)
    assert (done.report.first()["expired_snapshots"], done.outcomes.count()) == (2, 0)
    assert same_rows(spark.read.schema(rows.schema).parquet(path), rows)


def test_added_columns_survive(spark, folder):
    first = literal_table(spark, [(1, "2024-01-01"), (2, None)], "id bigint, dt string")
    second = literal_table(spark, [(3, "n", "2024-01-01"), (4, "m", None)], "id bigint, note string, dt string")
    for part in (first, second):
        maintenance.append_rows(part.coalesce(1), folder)
    maintenance.compact_partitions(spark, folder, maintenance.table_files(spark, folder), second.schema)
    got = sorted((r["id"], r["note"], r["dt"]) for r in spark.read.schema(second.schema).parquet(folder).collect())
    assert got == [(1, None, "2024-01-01"), (2, None, None), (3, "n", "2024-01-01"), (4, "m", None)]


def test_cleanup_by_table(spark):
    classified = literal_table(spark, [("a", 1, True), ("a", 2, False), ("b", 1, False), (None, 1, True)], "table_name string, version bigint, expired boolean")
    orphans = literal_table(spark, [("a", 10), ("a", 5), (None, 7)], "table_name string, length bigint")
    manifests = literal_table(spark, [("a", "m")], "table_name string, manifest_list string")
    report = lake.cleanup_by_table(classified, orphans, manifests).orderBy(F.col("table_name").asc_nulls_last()).collect()
    assert [tuple(r) for r in report] == [("a", 1, 1, 2, 2, 15, 1), ("b", 0, 1, 1, 0, 0, 0), (None, 1, 0, 1, 1, 7, 0)]


def test_manifests_by_table(spark):
    rows = [("a", "m1", True), ("a", "m1", False), ("a", "m2", True), ("b", "m1", True), (None, "m1", True)]
    found = lake.orphan_manifests_by_table(literal_table(spark, rows, "table_name string, manifest_list string, expired boolean"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([("a", "m2"), ("b", "m1"), (None, "m1")], key=str)
