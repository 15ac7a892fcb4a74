"""Groupings, distinct counts and quantiles equal Spark's own on skewed rows with nulls."""

import pytest
from pyspark.sql import functions as F

from harborline.operators import aggregates
from harborline.operators.quantiles import exact_quantiles
from tests.conftest import same_rows

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, values with many copies, nulls everywhere."""
    base = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("d"),
        F.when(F.col("id") % 13 > 0, F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(1000)) / 8)).alias("v"),
    )
    return base.repartition(5).cache()


@pytest.mark.parametrize("band,limit", [(0.01, 10**9), (0.01, 0), (0.0, 10**9), (0.0001, 0)])
def test_quantiles_equal_sorted_values(rows, band, limit):
    """Also where the band misses, and with a value that half of the rows share."""
    wanted = {"least": 0.0, "q": 0.25, "mid": 0.5, "late": 0.999, "most": 1.0}
    found = exact_quantiles(rows, ["k"], "v", wanted, band, limit)
    expected = rows.where("v IS NOT NULL").groupBy("k").agg(*[F.round(F.percentile("v", p), 9).alias(n) for n, p in wanted.items()])
    assert same_rows(found.select("k", *[F.round(n, 9) for n in wanted]), expected)


def test_quantiles_of_whole_numbers_nan_and_all_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, NAN), (1, 1.0), (2, NAN), (3, None), (4, float("inf"))], "k int, v double")
    found = {r["k"]: (r["low"], r["top"]) for r in exact_quantiles(df, ["k"], "v", {"low": 0.5, "top": 1.0}).collect()}
    assert set(found) == {1, 2, 4} and found[1][0] == 2.0 and str(found[1][1]) == "nan" and str(found[2][0]) == "nan" and found[4][1] == float("inf")
    whole = spark.range(1, 10_002).select(F.lit(1).alias("one"), "id")
    assert exact_quantiles(whole, ["one"], "id", {"m": 0.5}).first()["m"] == 5001


def test_quantiles_sort_a_small_share_of_the_rows(spark, monkeypatch):
    """With all values distinct, rows that are sorted are those of the bands."""
    from harborline.operators import quantiles

    written = []
    keep = quantiles.stage
    monkeypatch.setattr(quantiles, "stage", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.rand(1).alias("v"))
    exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    counts = [w for label, w in written if label == "quantile-counts"]
    assert len(counts) == 1 and counts[0].count() < 0.03 * 200_000


def test_distinct_aggregates_equal_sparks(rows):
    found = aggregates.distinct_aggregates(
        rows, ["k", "d"], {"a": ("count", "v"), "b": ("sum", "v"), "c": ("count", "d")}, {"n": F.count(F.lit(1))})
    expected = rows.groupBy("k", "d").agg(
        F.count_distinct("v").alias("a"), F.sum_distinct("v").alias("b"), F.count_distinct("d").alias("c"), F.count(F.lit(1)).alias("n"))
    assert same_rows(found.select("k", "d", "a", "b", "c", "n"), expected)


def test_grouping_sets_equal_sparks(rows):
    found = aggregates.grouping_sets(
        rows, ["k", "d"], aggregates.cube_sets(["k", "d"]),
        {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    expected = rows.cube("k", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.grouping("k").cast("bigint").alias("g_k"), F.grouping("d").cast("bigint").alias("g_d"))
    assert same_rows(found, expected)
    assert aggregates.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
