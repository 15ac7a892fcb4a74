"""Planning of lake-table maintenance on metadata tables; nothing here touches a file.

``snapshots``: ``table_name, snapshot_id, committed_at, ...``; ``manifest_files``: ``table_name,
snapshot_id, file_path, record_count, file_size, dt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import with_group_columns
from harborline.operators.topn import newest_per_key

# Default small-file threshold and compaction target in bytes.
SMALL_FILE_BYTES = 64 * 1024 * 1024
TARGET_FILE_BYTES = 128 * 1024 * 1024


def list_tables(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("table_name").distinct()


def current_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per table."""
    rest = [c for c in snapshots.columns if c != "table_name"]
    return (
        snapshots.groupBy("table_name")
        .agg(F.max_by(F.struct(*rest), F.struct("committed_at", "snapshot_id")).alias("s"))
        .select("table_name", "s.*")
    )


def table_detail(snapshots: DataFrame, manifest_files: DataFrame) -> DataFrame:
    """Files of each table's current snapshot; a table without files keeps one row of nulls."""
    files = manifest_files.withColumnsRenamed({"table_name": "__table", "snapshot_id": "__snapshot"})
    owned = F.col("table_name").eqNullSafe(F.col("__table")) & (F.col("snapshot_id") == F.col("__snapshot"))
    return current_snapshots(snapshots).join(files, owned, "left").drop("__table", "__snapshot")


def snapshot_summary(manifest_files: DataFrame, operation: str = "append") -> DataFrame:
    """Added records and files per snapshot, as columns and as the summary map."""
    sums = manifest_files.groupBy("snapshot_id").agg(
        F.sum("record_count").alias("added_records"), F.count(F.lit(1)).alias("added_data_files")
    )
    return sums.withColumn(
        "summary",
        F.create_map(
            F.lit("operation"), F.lit(operation),
            F.lit("added-records"), F.col("added_records").cast("string"),
            F.lit("added-data-files"), F.col("added_data_files").cast("string"),
        ),
    )


def classify_snapshots(snapshots: DataFrame, retain_last_n: int, cutoff: Column) -> DataFrame:
    """Add ``expired``: older than the table's last ``n`` snapshots and committed before ``cutoff``.

    The current snapshot is kept even for ``n = 0``.  Only the newest ``n`` per table are ranked;
    all other snapshots are compared with the oldest of those.
    """
    kept = newest_per_key(
        snapshots.select("table_name", "committed_at", "snapshot_id"),
        ["table_name"], ["committed_at", "snapshot_id"], max(retain_last_n, 1),
    )
    floor = kept.groupBy("table_name").agg(
        F.min(F.struct("committed_at", "snapshot_id")).alias("__floor")
    )
    place = F.struct("committed_at", "snapshot_id")
    return (
        with_group_columns(snapshots, floor, ["table_name"])
        .withColumn("expired", F.coalesce((place < F.col("__floor")) & (F.col("committed_at") < cutoff), F.lit(False)))
        .drop("__floor")
    )


def orphan_manifests(classified: DataFrame, manifest: str = "manifest_list") -> DataFrame:
    """Manifests of expired snapshots that no retained snapshot uses.

    One aggregate instead of an anti join: a manifest is an orphan if all its users are expired.
    """
    return (
        classified.groupBy(manifest)
        .agg(F.bool_and("expired").alias("__all"))
        .where("__all")
        .select(manifest)
    )


def orphan_manifests_by_table(classified: DataFrame, manifest: str = "manifest_list") -> DataFrame:
    """``table_name`` and manifest where all of the table's snapshots that use it are expired."""
    used = classified.groupBy("table_name", manifest).agg(F.bool_and("expired").alias("__all"))
    return used.where("__all").drop("__all")


def orphan_files(listed: DataFrame, referenced: DataFrame, path: str = "path") -> DataFrame:
    """Listed files no retained manifest refers to.  References are made unique before the shuffle."""
    return listed.join(referenced.select(path).distinct(), path, "left_anti")


def reclaimed(orphans: DataFrame, length: str = "length") -> DataFrame:
    return orphans.agg(
        F.count(F.lit(1)).alias("orphan_files"),
        F.coalesce(F.sum(length), F.lit(0)).alias("reclaimed_bytes"),
    )


def cleanup_report(classified: DataFrame, orphans: DataFrame, length: str = "length") -> DataFrame:
    """One row of counts.  The ids and paths stay in the long tables they are counted from."""
    files = reclaimed(orphans, length).select(F.struct("*")).scalar()
    return classified.agg(
        F.count_if("expired").alias("expired_snapshots"),
        F.count_if(~F.col("expired")).alias("retained_snapshots"),
    ).select(
        "*", files["orphan_files"].alias("orphan_files"), files["reclaimed_bytes"].alias("reclaimed_bytes")
    )


def cleanup_by_table(
    classified: DataFrame, orphans: DataFrame, manifests: DataFrame, length: str = "length"
) -> DataFrame:
    """Clean-up per table: snapshots by fate, files and bytes reclaimed, manifests dropped, last version.

    ``classified`` has ``version``; ``orphans`` and ``manifests`` have ``table_name``.  A null name is a
    table like any other.
    """
    snapshots = classified.groupBy("table_name").agg(
        F.count_if("expired").alias("expired_snapshots"), F.count_if(~F.col("expired")).alias("retained_snapshots"),
        F.max("version").alias("metadata_version"),
    )
    files = orphans.groupBy("table_name").agg(F.count(F.lit(1)).alias("orphan_files"), F.sum(length).alias("reclaimed_bytes"))
    dropped = manifests.groupBy("table_name").agg(F.count(F.lit(1)).alias("deleted_manifests"))
    joined = snapshots
    for part in (files, dropped):
        renamed = part.withColumnRenamed("table_name", "__table")
        joined = joined.join(renamed, F.col("table_name").eqNullSafe(F.col("__table")), "left").drop("__table")
    return joined.na.fill(0, ["orphan_files", "reclaimed_bytes", "deleted_manifests"])


def compaction_groups(
    files: DataFrame, threshold: int = SMALL_FILE_BYTES, target: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Partitions with two or more files below ``threshold`` bytes, and the files to write instead."""
    return (
        files.where(F.col("file_size") < threshold)
        .groupBy("table_name", "dt")
        .agg(F.count(F.lit(1)).alias("small_files"), F.sum("file_size").alias("small_bytes"))
        .where("small_files >= 2")
        .withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("small_bytes") / target)).cast("int"))
    )


def small_files(
    files: DataFrame, threshold: int = SMALL_FILE_BYTES, target: int = TARGET_FILE_BYTES
) -> DataFrame:
    """The files a compaction would read, with the number of files to write for their partition."""
    groups = compaction_groups(files, threshold, target).select("table_name", "dt", "bins")
    return with_group_columns(files.where(F.col("file_size") < threshold), groups, ["table_name", "dt"])


def compaction_report(groups: DataFrame, written: DataFrame) -> DataFrame:
    """Merged files and bytes before and after per partition."""
    after = written.groupBy("table_name", "dt").agg(
        F.count(F.lit(1)).alias("new_files"), F.sum("file_size").alias("compacted_bytes")
    )
    return with_group_columns(groups, after, ["table_name", "dt"]).select(
        "table_name", "dt", F.col("small_files").alias("files_merged"),
        F.col("small_bytes").alias("original_bytes"), "new_files", "compacted_bytes",
    )
