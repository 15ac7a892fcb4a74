"""Physical plans: no cross products or Python rows in queries, and pruning that reaches the scan."""

import pytest

from harborline.plans import QUERIES as PLANS
from harborline.operators.joins import interval_join, range_join
from harborline.plans.registry import Tables
from tests.conftest import SF

QUERIES = dict(PLANS)
RUNS_JOBS = ("x", "l3", "l5", "l11", "s9")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(RUNS_JOBS)))
def test_no_pairwise_or_python_operators(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert [word for word in FORBIDDEN if word in plan] == []


def test_filter_and_columns_reach_the_scan(spark):
    query = QUERIES["b03_filter_predicates"](spark, SF)
    scan = spark._jvm.PythonSQLUtils.explainString(query._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate" in scan and "In(l_returnflag" in scan
    assert "l_extendedprice" not in scan and "l_tax" not in scan


def test_listing_reads_no_contents(spark):
    scan = plan_of(QUERIES["s5_list_files"](spark, SF))
    assert "content" not in scan[scan.index("ReadSchema"):]


def test_newest_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["t2_retain_last_n"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 3
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[first_exchange:]


def test_zones_are_joined_without_hints(spark):
    from harborline.operators.crypto import assign_zone
    from harborline.session import literal_table

    t = Tables(spark, SF)
    zones = literal_table(spark, [("https://m.ththth.example.net", "k")], "zone_path string, key_name string")
    plan = plan_of(assign_zone(t.pages, zones, "url"))
    assert "NestedLoop" not in plan and "ROWS_HINT" not in plan


def test_interval_and_range_joins_are_equi_joins(spark):
    t = Tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = t.events.selectExpr("user_id", "event_id AS a", "ts AS ats")
        b = t.events.selectExpr("user_id", "event_id AS b", "ts AS bts")
        joined = plan_of(interval_join(a, b, ["user_id"], "ats", "bts", 60, 60))
        ranged = plan_of(range_join(t.part, t.part.selectExpr("p_size * 1D AS lo", "p_size + 1D AS hi"),
                                    "p_size", "lo", "hi", 5.0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in (joined, ranged):
        assert "SortMergeJoin" in plan and "__bucket" in plan


@pytest.mark.parametrize("name", ["b16_cube", "b16_rollup", "b16_grouping_sets"])
def test_groupings_copy_aggregated_rows_only(spark, name):
    """Read from the top: the copies are made above an aggregate and an exchange, not above the scan."""
    plan = plan_of(QUERIES[name](spark, SF))
    below = plan[plan.index("Expand"):]
    assert plan.count("Expand") == 1 and "HashAggregate" in below and below.index("Exchange") < below.index("FileScan")


def test_distinct_counts_copy_no_rows(spark):
    assert "Expand" not in plan_of(QUERIES["b12_distinct_aggregates"](spark, SF))


def test_bucketed_tables_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["b08_bucketed_join"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_overlap_joins_are_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("b07_overlap_join", "b07_overlap_join_without_key"):
            assert "NestedLoop" not in plan_of(QUERIES[name](spark, SF)) and "Cartesian" not in plan_of(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
