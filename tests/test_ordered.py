"""Skew-safe ordered operators equal plain windows, on chunks and on the plain path."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from harborline.operators.ordered import (
    asof_join,
    peer_ranks,
    row_index,
    rows_frame,
    running,
    trailing_extrema,
    trailing_sum,
    with_group_columns,
)
from harborline.operators.topn import newest_per_key
from tests.conftest import same_rows

CHUNKED, PLAIN = 0, 10**9


@pytest.fixture(scope="module")
def skewed(spark, events):
    """Two thirds of the rows under one key, and some under a null key."""
    kind = F.when(F.col("event_id") % 3 > 0, "hot").when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return events.select("event_id", "ts", "value", kind.alias("kind"))


def window():
    return Window.partitionBy("kind").orderBy("ts", "event_id")


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_running(skewed, limit):
    cents = F.col("value").cast("decimal(18,2)")
    big = F.when(F.col("value") > 90, F.col("value"))
    upto = window().rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("kind")
    ours = running(
        skewed, ["kind"], ["ts", "event_id"],
        {"s": ("sum", cents), "c": ("count", big), "lo": ("min", F.col("value")), "hi": ("max", F.col("value")),
         "l": ("last", big), "n": ("group_count", F.lit(1)), "top": ("group_max", F.col("value"))},
        limit,
    ).withColumn("s", F.col("s").cast("double"))
    expected = skewed.select(
        "*", F.sum(cents).over(upto).cast("double"), F.count(big).over(upto), F.min("value").over(upto),
        F.max("value").over(upto), F.last(big, ignorenulls=True).over(upto), F.count(F.lit(1)).over(every),
        F.max("value").over(every),
    )
    assert same_rows(ours, expected)


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
@pytest.mark.parametrize("block", [3, 1000])
def test_rows_frame(skewed, limit, block):
    """Frames longer than a block, and lag and lead across blocks."""
    def mean(w):
        return F.round(F.avg("value").over(w.rowsBetween(-5, 3)), 6)

    ours = rows_frame(
        skewed, ["kind"], ["ts", "event_id"], 5, 3,
        {"m": mean, "lag4": lambda w: F.lag("value", 4).over(w), "lead3": lambda w: F.lead("value", 3).over(w)},
        block_rows=block, max_group_rows=limit,
    )
    expected = skewed.select("*", mean(window()), F.lag("value", 4).over(window()), F.lead("value", 3).over(window()))
    assert same_rows(ours, expected)


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_global_index(skewed, limit):
    ours = row_index(skewed, [], ["ts", "event_id"], "i", limit)
    assert [r[0] for r in ours.orderBy("ts", "event_id").select("i").collect()] == list(range(1, skewed.count() + 1))


def test_rows_of_one_place_span_chunks(spark, skewed, monkeypatch):
    """A million rows of one time are no one task's: positions are whole, and no chunk holds most rows."""
    from harborline.operators import ordered

    seen = []
    keep = ordered.stage
    monkeypatch.setattr(ordered, "stage", lambda df, label: seen.append((label, keep(df, label))) or seen[-1][1])
    same_time = skewed.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = row_index(same_time, ["kind"], ["ts"], max_group_rows=CHUNKED)
    places = found.groupBy("kind").agg(F.count_distinct("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("c"))
    assert places.where("a <> c OR b <> c").isEmpty()
    chunks = [df for label, df in seen if label == "chunks"][0]
    assert chunks.groupBy("__chunk").count().agg(F.max("count")).first()[0] < 0.3 * same_time.count()


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_peer_ranks_with_many_ties(skewed, limit):
    tied = skewed.withColumn("band", F.floor(F.col("value") / 25))
    w = Window.partitionBy("kind").orderBy("band")
    ranks = peer_ranks(tied, ["kind"], ["band"], limit).drop("peers")
    ours = with_group_columns(tied, ranks, ["kind", "band"]).select(
        "event_id", "rank", "dense_rank", F.round("percent_rank", 9), F.round("cume_dist", 9)
    )
    expected = tied.select(
        "event_id", F.rank().over(w).cast("bigint"), F.dense_rank().over(w).cast("bigint"),
        F.round(F.percent_rank().over(w), 9), F.round(F.cume_dist().over(w), 9),
    )
    assert same_rows(ours, expected)


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_asof_join_against_brute_force(spark, limit):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7), (5, "c", 4)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 7, "y"), ("b", 10, "z"), ("b", 3, "w")], "k string, rt int, v string")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "t", "rt", ["v"], limit).collect()}
    assert got == {1: "x", 2: None, 3: "w", 4: "y", 5: None}


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_trailing_sum_counts_peers_and_the_far_edge(spark, limit):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:10", 2), (3, "2024-01-01 00:00:10", 4),
            (4, "2024-01-01 00:00:11", 8), (5, "2024-01-01 00:01:00", 16)]
    df = spark.createDataFrame(rows, "id int, ts string, v bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = trailing_sum(df, [], "ts", 10, F.col("v"), "s", "c", limit)
    assert {r["id"]: (r["s"], r["c"]) for r in got.collect()} == {1: (1, 1), 2: (7, 3), 3: (7, 3), 4: (14, 3), 5: (16, 1)}


@pytest.mark.parametrize("limit", [CHUNKED, PLAIN])
def test_trailing_extrema_equal_a_range_frame(spark, skewed, limit):
    """Ties, nulls in key, time and value, and frames that open at a block's edge."""
    odd = skewed.select(
        F.when(F.col("event_id") % 17 > 0, F.col("kind")).alias("kind"), "event_id",
        F.when(F.col("event_id") % 19 > 0, F.date_trunc("minute", "ts").cast("timestamp_ntz")).alias("ts"),
        F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"),
    )
    got = trailing_extrema(odd, ["kind"], "ts", 6 * 3600, F.col("value"), "low", "high", limit)
    w = Window.partitionBy("kind").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600, 0)
    expected = odd.withColumns({"low": F.min("value").over(w), "high": F.max("value").over(w)})
    assert same_rows(got, expected)


@pytest.mark.parametrize("n", [1, 50, 10_000])
def test_newest_per_key(skewed, n):
    newest = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    expected = skewed.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n).drop("rn")
    assert same_rows(newest_per_key(skewed, ["kind"], ["ts", "event_id"], n, salts=4), expected)
