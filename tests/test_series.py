import pytest
from pyspark.sql import functions as F

from harborline.operators import metrics, series
from harborline.session import literal_table
from tests.conftest import same_rows

SCHEMA = "key string, value double, ts timestamp, id bigint"


def points(spark, counts):
    frames = [
        spark.range(n).select(
            F.lit(key).alias("key"), F.col("id").cast("double").alias("value"), F.timestamp_seconds("id").alias("ts"), "id")
        for key, n in counts.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def test_retention_at_its_limit(spark):
    kept = series.retain_last_n(points(spark, {"a": 719, "b": 720, "c": 721}))
    found = {r["key"]: (r["n"], r["first"]) for r in
             kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()}
    assert found == {"a": (719, 0), "b": (720, 0), "c": (720, 1)}


def test_query_keeps_request_order_duplicates_and_unknown_keys(spark):
    got = series.query_series(spark, points(spark, {"a": 2, "b": 1}), ["b", "none", "a", "b"]).orderBy("pos", "ts").collect()
    assert [(r["pos"], r["target"], r["value"]) for r in got] == [
        (0, "b", 0.0), (1, "none", None), (2, "a", 0.0), (2, "a", 1.0), (3, "b", 0.0)]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_chart_of_one_point_and_of_a_flat_line(spark, limit):
    rows = points(spark, {"one": 1}).union(
        points(spark, {"flat": 3}).withColumn("value", F.lit(7.0))).union(points(spark, {"line": 3}))
    got = {(r["key"], r["point_index"]): (r["x"], r["y"]) for r in series.scale_series(rows, limit).collect()}
    assert got[("one", 0)] == (20.0, 140.0)
    assert [got[("flat", i)] for i in range(3)] == [(20.0, 140.0), (400.0, 140.0), (780.0, 140.0)]
    assert [got[("line", i)] for i in range(3)] == [(20.0, 140.0), (400.0, 80.0), (780.0, 20.0)]


def test_latest_breaks_ties_by_id(spark):
    rows = spark.sql("SELECT 'a' AS key, CAST(id AS DOUBLE) AS value, TIMESTAMP '2024-01-01' AS ts, id FROM range(5)")
    assert series.series_summary(rows).first()["latest"] == 4.0


def test_latest_of_null_keys_and_null_times(spark):
    rows = literal_table(spark, [(None, 1.0, 5, 1), (None, 2.0, 5, 2), ("a", 3.0, None, 1), ("b", 4.0, 9, 1), ("b", 5.0, 1, 7)],
                         "key string, value double, ts int, id bigint")
    assert {r["key"]: (r["latest"], r["points"]) for r in series.series_summary(rows).collect()} == {
        None: (2.0, 2), "a": (None, 1), "b": (4.0, 2)}


def test_summary_hashes_instead_of_sorting(spark):
    plan = series.series_summary(points(spark, {"a": 2}))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_bins_are_half_open(spark):
    rows = points(spark, {"a": 20})
    at = lambda s: F.timestamp_seconds(F.lit(s))
    got = series.range_and_bin(rows, at(5), at(15), "5 seconds").orderBy("bin_start").collect()
    assert [(r["points"], r["min_value"], r["max_value"], r["avg_value"]) for r in got] == [(5, 5, 9, 7), (5, 10, 14, 12)]


def test_annotations_append_and_filter(spark, folder):
    rows = points(spark, {"a": 3})
    made = series.annotations(rows, F.col("ts"), F.lit("Commit"), F.concat(F.lit("n="), "id"), F.array(F.lit("gc"), F.col("key")))
    series.append_annotations(made.where("id = 2"), folder)
    series.append_annotations(made.where("id < 2"), folder)
    stored = spark.read.parquet(folder)
    assert [r["text"] for r in series.get_annotations(stored).collect()] == ["n=0", "n=1", "n=2"]
    assert series.get_annotations(stored, "a").count() == 3 and series.get_annotations(stored, "b").isEmpty()


def test_bucket_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([("q", v) for v in (0.001, 0.0011, 2.5, 2.6, None)], "status string, secs double")
    got = {r["le"]: r for r in metrics.cumulative_histogram(rows, "status", "secs").collect()}
    assert len(got) == 11
    assert [got[b]["cumulative"] for b in ("0.001", "0.005", "1", "2.5", "+Inf")] == [1, 2, 2, 3, 4]
    assert {r["total_count"] for r in got.values()} == {4}


def test_histogram_is_monotone_and_ends_at_the_count(events):
    rows = metrics.cumulative_histogram(events, "event_type", "value", [1.0, 10.0, 100.0]).orderBy("label", "le_index").collect()
    for label in {r["label"] for r in rows}:
        line = [r["cumulative"] for r in rows if r["label"] == label]
        assert line == sorted(line) and line[-1] == events.where(F.col("event_type") == label).count()


def test_exposition_escapes_labels(spark):
    df = literal_table(spark, [('a"b\\c\nd', None, 3)], "x string, y string, n bigint")
    assert metrics.exposition_lines(df, "m", ["x", "y"], "n").first()[0] == 'm{x="a\\"b\\\\c\\nd",y=""} 3'
    assert metrics.exposition_lines(df, "m", [], "n").first()[0] == "m 3"


def test_totals_and_gauges(spark):
    df = literal_table(spark, [("a", 1, 5), ("a", 2, -3), ("b", 1, 4)], "k string, t int, v bigint")
    assert metrics.total(df, "v").first()[0] == 6
    assert metrics.total(df.limit(0), "v").first()[0] == 0
    assert same_rows(metrics.gauge_last(df, "k", "v", "t", "t"), literal_table(spark, [("a", -3), ("b", 4)], "key string, gauge bigint"))
    assert same_rows(metrics.gauge_net(df, "k", F.col("v")), literal_table(spark, [("a", 2), ("b", 4)], "key string, gauge bigint"))
