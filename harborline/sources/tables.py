"""Parquet tables: named views, reads, partitioned writes and per-file row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.session import literal_table
from harborline.sources.files import list_files, parquet_footers

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, root: str, names: Sequence[str] = TABLES) -> None:
    """Make each Parquet table under ``root`` queryable by its name."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def read_parquet(spark: SparkSession, *paths: str, base_path: str | None = None) -> DataFrame:
    reader = spark.read
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.parquet(*paths)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> int:
    """Write Parquet, without a shuffle, and return the bytes of the files that are then in ``path``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return list_files(df.sparkSession, path, "*.parquet").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def parquet_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows per Parquet file of a file or folder, from the footers."""
    return parquet_footers(list_files(spark, path, "*.parquet")).select(F.col("path").alias("file_path"), "record_count")


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as a catalog table in ``path``, hashed to ``buckets`` by ``keys`` and sorted by them within each.

    Tables bucketed alike join and group by these keys without moving a row.  The one shuffle is here; every
    bucket is one file of one task.  ``name`` must be new.
    """
    placed = df.repartition(buckets, *keys)
    placed.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def _json_ready(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        column = F.unix_millis(column.cast("timestamp"))
    return column.alias(field.name)


def epoch_columns(df: DataFrame) -> DataFrame:
    """Replace timestamp columns by epoch milliseconds; all other types stay as they are."""
    return df.select([_json_ready(f) for f in df.schema.fields])


def rows_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept, timestamps as epoch milliseconds."""
    ready = epoch_columns(df)
    return ready.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in ready.columns]), {"ignoreNullFields": "false"})
        .alias("row_json")
    )


def describe_fields(df: DataFrame) -> DataFrame:
    """Field id, name, type and whether the schema requires a value, one row per column.

    The schema is all that is looked at; no job runs.
    """
    rows = [(i + 1, f.name, not f.nullable, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return literal_table(df.sparkSession, rows, "id bigint, name string, required boolean, field_type string")
