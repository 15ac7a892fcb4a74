from pyspark.sql import functions as F

from harborline.session import literal_table
from harborline.sources import files, tables
from tests.conftest import SF, same_rows


def test_prefix_stops_at_a_separator(spark):
    df = literal_table(spark, [("/a",), ("/a/b",), ("/ab",)], "path string")
    for prefix in ("/a", "/a/"):
        assert sorted(r[0] for r in files.list_prefix(df, prefix).collect()) == ["/a", "/a/b"]


def test_partitioned_round_trip(spark, folder):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    tables.write_parquet(orders, folder, ["o_orderstatus"])
    assert same_rows(tables.read_parquet(spark, folder).select(*orders.columns), orders)
    pruned = tables.read_parquet(spark, f"{folder}/o_orderstatus=F", base_path=folder)
    assert same_rows(pruned.select(*orders.columns), orders.where("o_orderstatus = 'F'"))


def test_summary_counts_every_file(spark, folder):
    spark.range(100).repartition(4).write.parquet(folder)
    summary = tables.parquet_summary(spark, folder)
    assert (summary.count(), summary.agg(F.sum("record_count")).first()[0]) == (4, 100)


def test_summary_reads_footers_only(spark, folder):
    """A file whose row groups are overwritten with zeros still tells its rows."""
    from pathlib import Path
    from urllib.parse import urlparse

    spark.range(100_000).coalesce(1).write.parquet(folder)
    name = Path(urlparse(files.list_files(spark, folder, "*.parquet").first()["path"]).path)
    raw = bytearray(name.read_bytes())
    footer = int.from_bytes(raw[-8:-4], "little") + 8
    raw[4:-footer] = bytes(len(raw) - 4 - footer)
    name.write_bytes(raw)
    (name.parent / f".{name.name}.crc").unlink(missing_ok=True)
    assert tables.parquet_summary(spark, folder).first()["record_count"] == 100_000


def test_listing_matches_summary_paths(spark, folder):
    spark.range(10).withColumn("dt", F.lit("a b:c")).write.partitionBy("dt").parquet(folder)
    listed = files.list_files(spark, folder, "*.parquet").select("path")
    summed = tables.parquet_summary(spark, folder).select(F.col("file_path").alias("path"))
    assert same_rows(listed, summed)
    assert files.storage_bytes(files.list_files(spark, folder), F.lit("all")).first()["total_bytes"] > 0


def test_delete_is_dry_by_default_and_reports_what_happened(spark, folder):
    spark.range(10).withColumn("dt", F.lit("a b:c")).write.partitionBy("dt").parquet(folder)
    doomed = spark.createDataFrame(files.list_files(spark, folder, "*.parquet").select("path").collect())
    assert {r["outcome"] for r in files.delete_files(doomed).collect()} == {"planned"}
    assert files.list_files(spark, folder, "*.parquet").count() == doomed.count()
    assert {r["outcome"] for r in files.delete_files(doomed, dry_run=False).collect()} == {"deleted"}
    assert {r["outcome"] for r in files.delete_files(doomed, dry_run=False).collect()} == {"absent"}
    failing = literal_table(spark, [(f"file:{folder}",)], "path string")
    assert files.delete_files(failing, dry_run=False).first()["outcome"].startswith("failed")


def test_whole_text_keeps_lines(spark, folder):
    spark.createDataFrame([("a\nb",), ("c",)], "value string").coalesce(1).write.text(folder)
    assert [r["content"] for r in files.read_text(spark, folder).collect()] == ["a\nb\nc\n"]


def test_json_rows_keep_nulls_and_milliseconds(spark):
    df = spark.sql("SELECT 1L AS a, TIMESTAMP_NTZ '2024-03-09 16:00:00.1239' AS t, CAST(NULL AS STRING) AS s, 1.5D AS d")
    assert tables.rows_json(df).first()[0] == '{"a":1,"t":1710000000123,"s":null,"d":1.5}'


def test_describe_fields(spark):
    df = literal_table(spark, [(1, None), (2, "x")], "a bigint NOT NULL, b string")
    assert [tuple(r) for r in tables.describe_fields(df).collect()] == [(1, "a", True, "bigint"), (2, "b", False, "string")]


def test_empty_result_keeps_its_columns(spark):
    df = literal_table(spark, [], "a bigint, b string")
    assert df.columns == ["a", "b"] and tables.rows_json(df).columns == ["row_json"]
