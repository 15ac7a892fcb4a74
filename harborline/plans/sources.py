"""Sources and sinks: views, Parquet and text round trips, listings, deletes, JSON rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.plans.registry import Tables, query
from harborline.session import new_folder, stage
from harborline.sources import files, tables

_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in tables.TABLES)


@query("s1_register_tables", _COUNTS)
def s1_register_tables(t: Tables):
    tables.register_tables(t.spark, t.root)
    return t.spark.sql(_COUNTS)


@query("s2_read_parquet", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def s2_read_parquet(t: Tables):
    return tables.read_parquet(t.spark, f"{t.root}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")


@query(
    "s3_write_parquet",
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
)
def s3_write_parquet(t: Tables):
    path = new_folder(t.spark, "orders")
    if not tables.write_parquet(t.orders, path, partition_by=["o_orderstatus"]):
        raise RuntimeError("nothing was written")
    return tables.read_parquet(t.spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
    )


@query("s4_parquet_summary", "SELECT 'lineitem.parquet' AS file_name, count(*) AS record_count FROM lineitem")
def s4_parquet_summary(t: Tables):
    return tables.parquet_summary(t.spark, f"{t.root.rstrip('/')}/lineitem.parquet").select(
        F.substring_index("file_path", "/", -1).alias("file_name"), "record_count"
    )


_NAMES = ", ".join(f"('{n}.parquet')" for n in tables.TABLES)


@query("s5_list_files", f"SELECT file_name, true AS has_bytes FROM (VALUES {_NAMES}) AS v(file_name)")
def s5_list_files(t: Tables):
    return files.list_files(t.spark, t.root, "*.parquet").select(
        F.substring_index("path", "/", -1).alias("file_name"), (F.col("length") > 0).alias("has_bytes")
    )


_PREFIX = "https://ththin.example.com"


@query("s6_list_prefix", f"SELECT page_id, url FROM pages WHERE url = '{_PREFIX}' OR starts_with(url, '{_PREFIX}/')")
def s6_list_prefix(t: Tables):
    return files.list_prefix(t.pages.select("page_id", "url"), _PREFIX, "url")


@query(
    "s7_storage_bytes",
    """
    SELECT o_orderstatus AS part, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_bytes
    FROM orders GROUP BY o_orderstatus
    """,
)
def s7_storage_bytes(t: Tables):
    listed = t.orders.select(F.col("o_orderstatus").alias("part"), F.floor("o_totalprice").alias("length"))
    return files.storage_bytes(listed, "part")


@query(
    "s8_read_text",
    "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang",
)
def s8_read_text(t: Tables):
    """Documents written as text files and read back as whole files; each text gains a line feed."""
    path = new_folder(t.spark, "texts")
    t.documents.select("text", "lang").write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    return (
        files.read_text(t.spark, path)
        .groupBy(F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang"))
        .agg(F.sum(F.char_length("content")).alias("chars"))
    )


@query(
    "s9_delete_files",
    "SELECT CAST(quality AS VARCHAR) AS quality, CAST(1 AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS absent_again FROM labels GROUP BY quality",
)
def s9_delete_files(t: Tables):
    """A copy of ``labels``, one file per quality, is deleted, and deleted again as a retried task would."""
    path = new_folder(t.spark, "doomed")
    tables.write_parquet(t.labels.repartition("quality"), path, partition_by=["quality"])
    doomed = stage(files.list_files(t.spark, path, "*.parquet").select("path"), "doomed-list")
    rounds = [stage(files.delete_files(doomed, dry_run=False).withColumn("round", F.lit(i)), "deletes") for i in range(2)]
    if not files.list_files(t.spark, path, "*.parquet").isEmpty():
        raise RuntimeError("files are left")
    value = F.regexp_extract("path", "/quality=([^/]*)/", 1)
    return rounds[0].union(rounds[1]).groupBy(F.when(value != "__HIVE_DEFAULT_PARTITION__", value).alias("quality")).agg(
        F.count_if((F.col("round") == 0) & (F.col("outcome") == "deleted")).alias("deleted"),
        F.count_if((F.col("round") == 1) & (F.col("outcome") == "absent")).alias("absent_again"),
    )


@query(
    "s10_rows_json",
    """
    SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value, json_extract_string(props, '$.k') AS k FROM events
    """,
)
def s10_rows_json(t: Tables):
    """Rows to JSON text and back; timestamps travel as epoch milliseconds."""
    parsed = tables.rows_json(t.events).select(
        F.from_json("row_json", "event_id bigint, ts bigint, event_type string, value double, props string").alias("r")
    )
    return parsed.select(
        "r.event_id", F.col("r.ts").alias("ts_ms"), "r.event_type", "r.value",
        F.get_json_object("r.props", "$.k").alias("k"),
    )


@query(
    "l13_describe_schema",
    """
    SELECT CAST(id AS BIGINT) AS id, name, required, field_type FROM (
        SELECT 1 AS id, 'doc_id' AS name, false AS required, 'bigint' AS field_type
        UNION ALL SELECT 2, 'text', false, 'string'
        UNION ALL SELECT 3, 'lang', false, 'string'
        UNION ALL SELECT 4, 'source', false, 'string'
        UNION ALL SELECT 5, 'n_chars', false, 'bigint')
    """,
)
def l13_describe_schema(t: Tables):
    return tables.describe_fields(t.documents)
