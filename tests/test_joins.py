import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborline.operators.joins import interval_join, longest_prefix_join, not_in, overlap_join, range_join
from harborline.operators.sets import except_all, intersect_all
from harborline.session import literal_table
from tests.conftest import same_rows

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(
    points=st.lists(st.integers(0, 60), min_size=1, max_size=20),
    spans=st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=8),
    width=st.sampled_from([1.0, 7.0, 100.0]),
)
def test_range_join_equals_all_pairs(spark, points, spans, width):
    p = literal_table(spark, list(enumerate(points)), "id int, v int")
    r = literal_table(spark, [(i, float(a), float(a + n)) for i, (a, n) in enumerate(spans)], "rid int, lo double, hi double")
    got = {(x["id"], x["rid"]) for x in range_join(p, r, "v", "lo", "hi", width).collect()}
    assert got == {
        (i, j) for (i, v), (j, (a, n)) in itertools.product(enumerate(points), enumerate(spans)) if a <= v < a + n
    }


@FEW
@given(
    left=st.lists(st.integers(0, 100), min_size=1, max_size=15), right=st.lists(st.integers(0, 100), min_size=1, max_size=15),
    before=st.integers(0, 20), after=st.integers(0, 20),
)
def test_interval_join_equals_all_pairs(spark, left, right, before, after):
    def timed(rows, name):
        return literal_table(spark, list(enumerate(rows)), f"{name} int, s int").select(
            F.lit(1).alias("k"), name, F.timestamp_seconds("s").alias(f"{name}_ts")
        )

    joined = interval_join(timed(left, "a"), timed(right, "b"), ["k"], "a_ts", "b_ts", before, after)
    got = sorted((x["a"], x["b"]) for x in joined.collect())
    assert got == sorted(
        (i, j) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if -before <= y - x <= after
    )


def test_longest_prefix(spark):
    paths = literal_table(spark, [(p,) for p in ("/a", "/ab", "/a/b/c", "/a/b", "/x/y", "/a/", "/")], "path string")
    zones = literal_table(spark, [("/a", "1"), ("/a/b/", "2"), ("/x/y/z", "3")], "zone_path string, key_name string")
    expected = {"/a": "1", "/ab": None, "/a/b/c": "2", "/a/b": "2", "/x/y": None, "/a/": "1", "/": None}
    got = longest_prefix_join(paths, "path", zones, "zone_path", ["key_name"])
    assert {r["path"]: r["key_name"] for r in got.collect()} == expected


def test_ranges_without_end_and_of_all_widths(spark):
    inf = float("inf")
    spans = [(-inf, inf), (0.0, 1e12), (2.5, 2.75), (3.0, 3.0), (None, 4.0), (-7.0, 1e6), (1e300, inf)]
    values = [-1e9, -7.0, 0.0, 2.5, 2.74, 2.75, 3.0, 999999.0, 1e11, 1e301, None]
    points = literal_table(spark, [(v,) for v in values], "v double")
    ranges = literal_table(spark, spans, "lo double, hi double")
    got = sorted(tuple(r) for r in range_join(points, ranges, "v", "lo", "hi", 5.0).collect())
    assert got == sorted((v, a, b) for v in values if v is not None for a, b in spans if a is not None and a <= v < b)


def test_longest_prefix_without_zones(spark):
    paths = literal_table(spark, [("/a",)], "path string")
    zones = literal_table(spark, [], "zone_path string, key_name string")
    got = longest_prefix_join(paths, "path", zones, "zone_path", ["key_name"])
    assert [tuple(r) for r in got.collect()] == [("/a", None, None)]


def test_not_in_follows_null_rules(spark):
    left = literal_table(spark, [(1,), (2,), (None,)], "id int")
    for listed in ([(2,)], [(2,), (None,)], []):
        right = literal_table(spark, listed, "r int")
        left.createOrReplaceTempView("not_in_left")
        right.createOrReplaceTempView("not_in_right")
        expected = spark.sql("SELECT id FROM not_in_left WHERE id NOT IN (SELECT r FROM not_in_right)")
        assert same_rows(not_in(left, "id", right, "r"), expected)


def test_multiset_operations(spark):
    a = literal_table(spark, [("x",)] * 5 + [("y",)] * 2 + [(None,)] * 2, "v string")
    b = literal_table(spark, [("x",)] * 3 + [("z",)] + [(None,)], "v string")
    assert same_rows(intersect_all(a, b), a.intersectAll(b))
    assert same_rows(except_all(a, b), a.exceptAll(b))


def test_multiset_copies_span_pieces(spark, monkeypatch):
    from harborline.operators import sets

    monkeypatch.setattr(sets, "_PIECE", 3)
    a = spark.range(10).selectExpr("1 AS v")
    assert except_all(a, spark.range(2).selectExpr("1 AS v")).count() == 8


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlap_join_equals_all_pairs(spark, keys):
    """Wide, narrow, touching, equal, empty, open and null ranges; each overlapping pair once."""
    import random

    draw = random.Random(4)
    inf = float("inf")
    odd = [(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 0.0, 10.0), (2, 5.0, 5.0), (2, 7.0, 3.0), (1, -inf, inf), (1, 3.0, inf), (None, 0.0, 9.0), (1, None, 4.0)]
    sides = []
    for n in range(2):
        rows = odd + [(draw.randint(1, 3), a, a + draw.choice([0.01, 1.0, 30.0, 500.0])) for a in (draw.uniform(-300, 300) for _ in range(60))]
        sides.append([(*r, i) for i, r in enumerate(rows)])
    left = spark.createDataFrame(sides[0], "k int, a double, b double, x int")
    right = spark.createDataFrame(sides[1], "k int, c double, d double, y int")
    if not keys:
        right = right.withColumnRenamed("k", "k2")
    got = sorted((r["x"], r["y"]) for r in overlap_join(left, right, ("a", "b"), ("c", "d"), 2.0, keys).collect())

    def meet(p, q):
        (k, a, b, _), (k2, c, d, _) = p, q
        if None in (a, b, c, d) or a >= b or c >= d or (keys and (k is None or k != k2)):
            return False
        return a < d and c < b

    assert got == sorted((p[3], q[3]) for p in sides[0] for q in sides[1] if meet(p, q))


def test_overlap_join_places_a_row_once_per_cell(spark):
    """One join, and no copies of rows for the levels that no range of the other side asks for."""
    from harborline.operators import joins

    rows = [(1, float(i), float(i) + n, i) for i, n in zip(range(0, 4000, 40), itertools.cycle([2, 30]))]
    left = spark.createDataFrame(rows, "k int, a double, b double, x int")
    right = spark.createDataFrame([(1, r[1] + 1, r[1] + 31, r[3]) for r in rows], "k int, c double, d double, y int")
    joined = overlap_join(left, right, ("a", "b"), ("c", "d"), 16.0, ["k"], left_sizes=left.select("a", "b"))
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert joined.count() == sum(a < d and c < b for _, a, b, _ in rows for c, d in [(r[1] + 1, r[1] + 31) for r in rows])
    placed = joins._place(left, "a", "b", 16.0, [0, 1], [1])
    assert placed.count() <= 1.5 * len(rows) and placed.where("__level <> 1").isEmpty()


def test_overlap_join_of_small_blocks_equals_all_pairs(spark, monkeypatch):
    """Cells of many parts and blocks: equal rows and ranges, wide and open ones; each pair as often as there are rows for it."""
    import random
    from collections import Counter

    from harborline.operators import joins

    for name, value in (("_PART_ROWS", 7), ("_LEFT_BLOCK", 2), ("_RIGHT_BLOCK", 3), ("_TASK_PAIRS", 50)):
        monkeypatch.setattr(joins, name, value)
    draw = random.Random(5)
    inf, nan = float("inf"), float("nan")
    sides = []
    for n in range(2):
        rows = [(a, a + draw.choice([0.1, 1.0, 1.0, 1.0, 40.0]), i) for i, a in enumerate(draw.uniform(0, 20) for _ in range(80))]
        sides.append(rows + rows[:9] + [(3.0, 4.0, 1)] * 12 + [(-inf, 2.0, 90), (5.0, inf, 91), (6.0, nan, 92), (None, 1.0, 93), (1.0, None, None), (2.0, 2.0, 95), (4.0, 5.0, None)])
    left = spark.createDataFrame(sides[0], "a double, b double, x int")
    right = spark.createDataFrame(sides[1], "c double, d double, y int")
    got = Counter(tuple(r) for r in overlap_join(left, right, ("a", "b"), ("c", "d"), 1.0).select("x", "y").collect())

    def less(p, q):
        return p is not None and q is not None and p == p and (q != q or p < q)

    want = Counter((x, y) for a, b, x in sides[0] for c, d, y in sides[1] if less(a, b) and less(c, d) and less(a, d) and less(c, b))
    assert got == want


def test_overlap_join_without_key_writes_few_bytes_a_pair(spark, folder):
    """Ranges that share a cell, in no order: pairs come out in the order of blocks, of which Parquet keeps runs and repeats."""
    import random

    draw = random.Random(6)
    left, right = (
        spark.createDataFrame([(n, a, a + 0.25) for n, a in enumerate(draw.uniform(0.0, 1.0) for _ in range(2500))], schema)
        for schema in ("x bigint, a double, b double", "y bigint, c double, d double")
    )
    overlap_join(left, right, ("a", "b"), ("c", "d"), 0.25).select("x", "y").write.parquet(folder)
    pairs = spark.read.parquet(folder).count()
    written = sum(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("length").collect())
    assert pairs > 2_000_000 and written < 0.5 * pairs


def test_overlap_join_without_key_moves_rows_of_shared_cells_only(spark, monkeypatch):
    """Of the many ranges that are nowhere near one of the other side, none reaches a block."""
    from harborline.operators import joins

    made, blocks = {}, joins._blocks

    def spy(placed, columns, low, high, side, *rest):
        made[side] = blocks(placed, columns, low, high, side, *rest)
        return made[side]

    monkeypatch.setattr(joins, "_blocks", spy)
    left = spark.createDataFrame([(n, n / 10.0, n / 10.0 + 1.0) for n in range(20)], "x int, a double, b double")
    right = spark.range(5000).selectExpr("id AS y", "CAST(id AS double) AS c", "id + 1.0D AS d")
    joined = overlap_join(left, right, ("a", "b"), ("c", "d"), 1.0)
    assert joined.count() == sum(n / 10.0 < m + 1 and m < n / 10.0 + 1.0 for n in range(20) for m in range(5000))
    assert made["right"].selectExpr("sum(size(__rows_right))").first()[0] <= 20
