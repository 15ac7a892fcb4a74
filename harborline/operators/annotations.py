"""Annotations of the package's own operations, one row per row of an operation's report.

Each function takes what the operation returns.  Where a report has no time of its own, the caller gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.series import annotations


def _text(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in columns])


def _tags(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def of_snapshots(snapshots: DataFrame) -> DataFrame:
    """Appends and replacements, from snapshot rows with ``added_records`` and ``added_data_files``."""
    text = _text("%s: %s with %d records in %d files", "table_name", "operation", "added_records", "added_data_files")
    return annotations(snapshots, F.col("committed_at"), F.lit("Snapshot Commit"), text, _tags("lake", "commit"))


def of_cleanup(report: DataFrame, time: Column) -> DataFrame:
    """Clean-ups that removed something, from the report per table."""
    busy = report.where("orphan_files > 0 OR expired_snapshots > 0")
    text = _text("Reclaimed %d bytes in %d files, %d snapshots expired", "reclaimed_bytes", "orphan_files", "expired_snapshots")
    return annotations(busy, time, F.lit("Orphan Purge"), text, _tags("lake", "cleanup"))


def of_compaction(report: DataFrame, time: Column) -> DataFrame:
    """Merged partitions, from groups to merge (``small_files``) or the report of what was merged (``files_merged``)."""
    count = "files_merged" if "files_merged" in report.columns else "small_files"
    return annotations(report, time, F.lit("Partition Compaction"), _text("Merged %d small files", count), _tags("lake", "compaction"))


def of_leases(leases: DataFrame) -> DataFrame:
    text = _text("Lease %d for role %s, %d seconds", "lease_id", "role", "ttl_secs")
    return annotations(leases, F.col("issue_time"), F.lit("Credential Issued"), text, _tags("lease", "issue"))


def of_expired_leases(leases: DataFrame) -> DataFrame:
    return annotations(leases, F.col("expire_time"), F.lit("Credential Expired"), _text("Lease %d for role %s", "lease_id", "role"), _tags("lease", "expiry"))


def of_revocations(revoked: DataFrame, time: Column) -> DataFrame:
    return annotations(revoked, time, F.lit("Credential Revoked"), _text("Lease %d", "lease_id"), _tags("lease", "revocation"))


def of_rolled_keys(rolled: DataFrame) -> DataFrame:
    text = _text("Key %s has version %s", "key_name", "version")
    return annotations(rolled, F.col("created_at"), F.lit("Master Key Rolled"), text, _tags("keys", "roll"))


def of_rewraps(summary: DataFrame, time: Column) -> DataFrame:
    text = _text("%d data keys below %s moved to %s of %s", "rewrapped_count", "zone_path", "target_version", "key_name")
    return annotations(summary, time, F.lit("Data Keys Rewrapped"), text, _tags("keys", "rewrap"))


def of_tickets(tickets: DataFrame) -> DataFrame:
    text = _text("%s for %s until %s", "server", "client", "__until")
    ready = tickets.withColumn("__until", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"))
    return annotations(ready, F.col("start_time"), F.lit("Ticket Issued"), text, _tags("ticket"))
