import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborline.functions import library as lib
from harborline.session import literal_table

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LONG = st.integers(-(2**62), 2**62)


@FEW
@given(pairs=st.lists(st.tuples(LONG, LONG), min_size=1, max_size=30))
def test_gcd(spark, pairs):
    fibonacci = [(2880067194370816120, 1779979416004714189), (0, 0), (0, 7), (-12, 18)]
    df = literal_table(spark, pairs + fibonacci, "a bigint, b bigint")
    for r in df.withColumn("g", lib.gcd(F.col("a"), F.col("b"))).collect():
        assert r["g"] == math.gcd(r["a"], r["b"])


@FEW
@given(pairs=st.lists(st.tuples(st.integers(-10**6, 10**6), st.integers(-10**6, 10**6)), min_size=1, max_size=30))
def test_lcm(spark, pairs):
    df = literal_table(spark, pairs + [(0, 0), (0, 3)], "a bigint, b bigint")
    for r in df.withColumn("l", lib.lcm(F.col("a"), F.col("b"))).collect():
        assert r["l"] == math.lcm(r["a"], r["b"])


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_definitions_that_differ_from_spark(spark):
    words = F.array(*[F.lit(w) for w in ("a", "b", "a", "c")])
    got = one(
        spark,
        cut=lib.trunc(F.lit(-7.9)), zero=lib.is_zero(F.lit(-0.0)), hexed=lib.to_hex(F.lit(255)),
        once=lib.regexp_replace_first(F.lit("a1\nb22c3"), "[0-9]+", "#"), none=lib.regexp_replace_first(F.lit("abc"), "[0-9]+", "#"),
        gone=lib.array_remove_first(words, F.lit("a")), same=lib.array_remove_first(words, F.lit("z")),
        last=lib.array_remove_first(words, F.lit("c")), mid=lib.array_slice_between(words, 2, 3), empty=lib.array_slice_between(words, 3, 2),
        longer=lib.array_resize(words, 5, F.lit("-")), shorter=lib.array_resize(words, 1, F.lit("-")),
        all_in=lib.array_has_all(words, F.array(F.lit("c"), F.lit("a"))), not_in=lib.array_has_all(words, F.array(F.lit("d"))),
        dims=lib.array_ndims(F.array(F.array(F.lit(1)))), where=lib.strpos(F.lit("abc"), "c"), nowhere=lib.strpos(F.lit("abc"), F.lit("x")),
    )
    assert got == {
        "cut": -7, "zero": True, "hexed": "ff", "once": "a#\nb22c3", "none": "abc", "gone": ["b", "a", "c"],
        "same": ["a", "b", "a", "c"], "last": ["a", "b", "a"], "mid": ["b", "a"], "empty": [], "longer": ["a", "b", "a", "c", "-"],
        "shorter": ["a"], "all_in": True, "not_in": False, "dims": 2, "where": 3, "nowhere": 0,
    }


def test_bins_before_the_epoch(spark):
    ts = F.lit("1969-12-31 23:59:59").cast("timestamp_ntz")
    assert str(one(spark, b=lib.date_bin(60, ts))["b"]) == "1969-12-31 23:59:00"


def test_digests_without_a_sql_counterpart(spark):
    got = one(spark, **{f"s{n}": F.sha2(F.lit("abc"), n) for n in (224, 384, 512)})
    assert got == {f"s{n}": hashlib.new(f"sha{n}", b"abc").hexdigest() for n in (224, 384, 512)}


def test_nth_value(spark):
    df = literal_table(spark, [("k", 3, "c"), ("k", 1, "a"), ("k", 2, "b")], "k string, o bigint, v string")
    row = df.groupBy("k").agg(lib.nth_value(F.col("v"), F.col("o"), 2).alias("n"), lib.nth_value(F.col("v"), F.col("o"), 9).alias("x")).first()
    assert (row["n"], row["x"]) == ("b", None)
