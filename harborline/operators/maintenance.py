"""Maintenance jobs on partitioned Parquet: append, read by manifest, compact in place, clean up.

A table is a folder ``path`` of Parquet files partitioned by one column.  Its history is two plain
tables that the caller keeps wherever it likes, with the columns of ``SNAPSHOT_SCHEMA`` and
``MANIFEST_SCHEMA``: a snapshot per change, and for each snapshot all files the table then had.  The
functions here take such tables, do the file work as Spark jobs and return the rows to append.  There is no lock: one writer at a time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators import lake
from harborline.operators.ordered import running, with_group_columns
from harborline.session import literal_table, stage
from harborline.sources.files import delete_files, list_files, parquet_footers

SNAPSHOT_SCHEMA = (
    "table_name string, snapshot_id bigint, parent_snapshot_id bigint, version bigint, committed_at timestamp, "
    "operation string, added_records bigint, added_data_files bigint, manifest_list string"
)
MANIFEST_SCHEMA = "table_name string, snapshot_id bigint, file_path string, record_count bigint, file_size bigint, dt string"

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Cleanup:
    """Long tables of one clean-up, and its report per table."""

    classified: DataFrame
    manifests: DataFrame
    outcomes: DataFrame
    report: DataFrame


def _decoded(text: Column) -> Column:
    """A path's text without ``%`` escapes; a plus is a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def table_files(spark: SparkSession, path: str, partition: str = "dt") -> DataFrame:
    """``file_path, file_size, record_count, dt`` of every file now below ``path``, from listing and footers.

    ``dt`` is the partition's value as text, null where rows have none.  A missing folder has no files.
    """
    try:
        listed = list_files(spark, path, "*.parquet")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_table(spark, [], "file_path string, file_size bigint, record_count bigint, dt string")
    value = F.regexp_extract(F.col("path"), f"/{partition}=([^/]*)/[^/]*$", 1)
    # Escaped once by the partition writer and once as a URI.
    text = _decoded(_decoded(value))
    return parquet_footers(listed.select("path", "length")).select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size"), "record_count",
        F.when(text != _NO_VALUE, text).alias("dt"),
    )


def append_rows(rows: DataFrame, path: str, partition: str = "dt") -> None:
    """Add ``rows`` to the table's files, which are left as they are."""
    if partition not in rows.columns:
        raise ValueError(f"rows need a {partition} column")
    rows.write.mode("append").partitionBy(partition).parquet(path)


def manifest(files: DataFrame, table_name: str, snapshot_id: int) -> DataFrame:
    """Rows of ``MANIFEST_SCHEMA``: the files of a snapshot."""
    return files.select(
        F.lit(table_name).alias("table_name"), F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), "file_path", "record_count", "file_size", "dt"
    )


def snapshot(
    files: DataFrame, parent: DataFrame, snapshots: DataFrame, table_name: str, snapshot_id: int, operation: str, now: dt.datetime
) -> DataFrame:
    """The row of ``SNAPSHOT_SCHEMA`` for a table that now has ``files``.

    ``parent`` holds the files of the snapshot before; what it lacks was added.  The version follows
    the latest of ``snapshots``.
    """
    added = files.join(parent.select("file_path"), "file_path", "left_anti")
    last = snapshots.where(F.col("table_name") == table_name).agg(
        F.max("version").alias("version"), F.max_by("snapshot_id", "version").alias("id")
    ).select(F.struct("*")).scalar()
    return added.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("added_records"), F.count(F.lit(1)).alias("added_data_files")
    ).select(
        F.lit(table_name).alias("table_name"), F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), last["id"].alias("parent_snapshot_id"),
        (F.coalesce(last["version"], F.lit(0)) + 1).alias("version"), F.lit(now).cast("timestamp").alias("committed_at"),
        F.lit(operation).alias("operation"), "added_records", "added_data_files", F.lit(f"{table_name}/{snapshot_id}").alias("manifest_list"),
    )


def read_files(spark: SparkSession, path: str, files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of those files of the table that a manifest lists, with the given columns.

    A semi join on the files' paths, so that a manifest of any size stays a table; columns that older
    files lack are null.
    """
    scan = spark.read.schema(schema).parquet(path).withColumn("__file", F.col("_metadata.file_path"))
    return scan.join(files.select("file_path"), F.col("__file") == F.col("file_path"), "left_semi").select(*schema.names)


def compaction_plan(
    files: DataFrame, threshold: int = lake.SMALL_FILE_BYTES, target: int = lake.TARGET_FILE_BYTES
) -> DataFrame:
    """``file_path``, ``dt`` and output ``bin`` of every file in the partitions that :func:`lake.compaction_groups` picks.

    Bins are numbered through all partitions.  Small files share the bins of their partition by running size, so files
    stay in order and a bin holds about ``target`` bytes; each larger file has a bin of its own.
    """
    keys = ["table_name", "dt"]
    groups = stage(lake.compaction_groups(files, threshold, target), "compaction-groups")
    chosen = with_group_columns(files.select(*keys, "file_path", "file_size"), groups, keys)
    small = F.col("file_size") < threshold
    bytes_of = F.when(small, F.col("file_size")).otherwise(F.lit(0))
    sized = running(
        chosen, keys, ["file_path"],
        {"__end": ("sum", bytes_of), "__large": ("sum", F.when(small, 0).otherwise(1).cast("bigint"))},
    )
    place = F.floor((F.col("__end") - F.col("file_size")) * F.col("bins") / F.col("small_bytes"))
    of_partition = F.when(small, F.least(place, F.col("bins") - 1)).otherwise(F.col("bins") + F.col("__large") - 1)
    # Staged: bins, rows and files are all counted from it.
    placed = stage(sized.select(*keys, "file_path", "file_size", of_partition.cast("bigint").alias("__place")), "compaction-places")
    ends = placed.groupBy(*keys).agg((F.max("__place") + 1).alias("__bins"))
    firsts = running(ends, [], keys, {"__upto": ("sum", F.col("__bins"))}).select(*keys, (F.col("__upto") - F.col("__bins")).alias("__first"))
    return with_group_columns(placed, firsts, keys).select(
        *keys, "file_path", "file_size", (F.col("__first") + F.col("__place")).cast("int").alias("bin")
    )


def compact_partitions(
    spark: SparkSession, path: str, files: DataFrame, schema: T.StructType, table_name: str = "", partition: str = "dt",
    threshold: int = lake.SMALL_FILE_BYTES, target: int = lake.TARGET_FILE_BYTES,
) -> DataFrame:
    """Rewrite the partitions that have two or more small files, in place; returns the report per partition.

    ``files`` are the table's files (:func:`table_files`).  Every bin goes to one task, in the order of files and of rows within
    them, and becomes one file.  The write replaces exactly the partitions it has rows of (dynamic
    overwrite): Spark writes new files beside the table and moves them in when all tasks are done, so
    lost tasks are repeated and a failed job changes nothing.  Readers of the old files must be done.
    The report counts what was really written; without such partitions nothing is written and it is empty.
    """
    known = stage(files.withColumn("table_name", F.lit(table_name)), "compaction-files")
    plan = stage(compaction_plan(known, threshold, target), "compaction-plan")
    bins = plan.agg(F.max("bin") + 1).first()[0]
    if bins:
        scan = (
            spark.read.schema(schema).parquet(path)
            .withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", F.col("_metadata.row_index"))
        )
        # The partition is joined as well, so that other partitions are not read.
        wanted = plan.select("file_path", F.col("bin").alias("__bin"), F.col("dt").cast(schema[partition].dataType).alias("__dt"))
        rows = scan.join(wanted, (F.col("__file") == F.col("file_path")) & F.col(partition).eqNullSafe(F.col("__dt")))
        (
            rows.repartitionById(int(bins), F.col("__bin")).sortWithinPartitions("__bin", "__file", "__row").select(*schema.names)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        )
    # Staged: the folder may change again before the report is read.
    now = stage(table_files(spark, path, partition).withColumn("table_name", F.lit(table_name)), "compaction-written")
    written = now.join(known.select("file_path"), "file_path", "left_anti")
    groups = plan.groupBy("table_name", "dt").agg(F.count(F.lit(1)).alias("small_files"), F.sum("file_size").alias("small_bytes"))
    return lake.compaction_report(groups, written)


def without_expired(snapshots: DataFrame, manifests: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables without the snapshots that ``classified`` calls expired, and without their manifests' rows.

    Write them anew where a clean-up was applied; a snapshot that was committed since stays.
    """
    gone = classified.where("expired").select(F.col("table_name").alias("__table"), F.col("snapshot_id").alias("__id"))
    owned = F.col("table_name").eqNullSafe(F.col("__table")) & (F.col("snapshot_id") == F.col("__id"))
    return snapshots.join(gone, owned, "left_anti"), manifests.join(gone, owned, "left_anti")


def clean_up(
    spark: SparkSession, path: str, snapshots: DataFrame, manifests: DataFrame, table_name: str,
    retain_last_n: int, cutoff: dt.datetime, apply: bool = False,
) -> Cleanup:
    """Find, or with ``apply`` delete, the files that no retained snapshot of the table at ``path`` has.

    These are files below ``path`` and files of expired manifests, for instance inputs of a
    compaction; one that is gone already counts as done, but not its bytes.  Manifests that only
    expired snapshots use are listed; :func:`without_expired` drops their rows.
    """
    own = F.col("table_name") == table_name
    classified = stage(lake.classify_snapshots(snapshots.where(own), retain_last_n, F.lit(cutoff).cast("timestamp")), "classified")
    fate = classified.select("snapshot_id", "expired")
    listed = manifests.where(own).join(fate, "snapshot_id").select(F.col("file_path").alias("path"), F.col("file_size").alias("length"), "expired")
    now = table_files(spark, path).select(F.col("file_path").alias("path"), F.col("file_size").alias("length"))
    known = now.unionByName(listed.where("expired").drop("expired")).groupBy("path").agg(F.max("length").alias("length"))
    # Written down before anything is deleted: a listing taken later would differ.
    doomed = stage(lake.orphan_files(known, listed.where(~F.col("expired"))), "orphans")
    outcomes = stage(delete_files(doomed, dry_run=not apply), "outcomes")
    done = doomed.join(outcomes.where("outcome IN ('deleted', 'absent', 'planned')"), "path").select(
        F.lit(table_name).alias("table_name"), F.when(F.col("outcome") == "absent", 0).otherwise(F.col("length")).alias("length")
    )
    dropped = lake.orphan_manifests(classified).withColumn("table_name", F.lit(table_name))
    return Cleanup(classified, dropped, outcomes, lake.cleanup_by_table(classified, done, dropped))
