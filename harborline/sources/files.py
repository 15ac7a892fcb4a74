"""File listings as DataFrames, and the delete job that runs on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One status row per file below ``root``; file contents are never read.

    ``path`` is the URI-encoded form that ``_metadata.file_path`` has everywhere else.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        F.col("_metadata.file_path").alias("path"), "length", "modificationTime"
    )


def under_prefix(path: Column, prefix: Column | str) -> Column:
    """True when ``path`` is ``prefix`` itself or lies below it (``/a`` does not cover ``/ab``)."""
    stem = F.rtrim(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/"))
    return (path == stem) | path.startswith(F.concat(stem, F.lit("/")))


def list_prefix(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    return files.where(under_prefix(F.col(path), prefix))


def storage_bytes(files: DataFrame, by: str | Column, length: str = "length") -> DataFrame:
    """Files and bytes per group."""
    key = F.col(by) if isinstance(by, str) else by
    return files.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), F.sum(length).alias("total_bytes")
    )


def read_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as text, one row per file, with malformed bytes replaced."""
    return spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob
    ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


# Names that Hadoop and Arrow give to the same kind of store, and kinds whose paths begin with a bucket.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_BY_BUCKET = ("s3", "gs")


class _Stores:
    """Arrow's file systems by URI, each opened once per task."""

    def __init__(self) -> None:
        self._open: dict[tuple[str, str], fs.FileSystem] = {}

    def locate(self, uri: str) -> tuple[fs.FileSystem, str]:
        parsed = urlparse(uri)
        place = (_SCHEMES.get(parsed.scheme, parsed.scheme), parsed.netloc)
        if place[0] in ("", "file"):
            return fs.LocalFileSystem(), unquote(parsed.path)
        name = f"{place[1]}{unquote(parsed.path)}" if place[0] in _BY_BUCKET else unquote(parsed.path)
        if place not in self._open:
            self._open[place] = fs.FileSystem.from_uri(f"{place[0]}://{place[1]}/")[0]
        return self._open[place], name


def _delete_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stores = _Stores()

    def remove(uri: str) -> str:
        try:
            store, name = stores.locate(uri)
            store.delete_file(name)
            return "deleted"
        except FileNotFoundError:
            return "absent"
        except (OSError, ValueError, NotImplementedError) as err:
            return f"failed: {err}"

    for pdf in batches:
        yield pdf.assign(outcome=[remove(p) for p in pdf["path"]])


def _footer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = _Stores()
    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            store, name = stores.locate(uri)
            with store.open_input_file(name) as file:
                footer = pq.read_metadata(file)
            found.append((footer.num_rows, footer.num_row_groups))
        for i, name in enumerate(("record_count", "row_groups")):
            batch = batch.append_column(name, pa.array([f[i] for f in found], pa.int64()))
        yield batch


def parquet_footers(files: DataFrame) -> DataFrame:
    """``files`` (as listed: ``path``, ...) with the ``record_count`` and ``row_groups`` their footers state.

    Executors open each file and read its footer only; no row group is touched.  A file that is not
    Parquet or is gone fails the job.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(_footer_batches, f"{schema}, record_count bigint, row_groups bigint")


def delete_files(doomed: DataFrame, dry_run: bool = True) -> DataFrame:
    """``(path, outcome)`` per path of ``doomed``; deletes on the executors unless ``dry_run``.

    A file that is already gone counts as done (``absent``), so a retried task is harmless, and a
    failed delete is reported instead of being counted as deleted.
    """
    paths = doomed.select(F.col("path").cast("string").alias("path"))
    if dry_run:
        return paths.withColumn("outcome", F.lit("planned"))
    return paths.mapInPandas(_delete_batches, "path string, outcome string")
