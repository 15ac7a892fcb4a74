"""Relational queries: scans, projections, filters, joins, aggregates, set operations, subqueries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harborline.operators.aggregates import cube_sets, distinct_aggregates, grouping_sets, rollup_sets
from harborline.operators.hierarchy import roots
from harborline.operators.joins import interval_join, not_in, overlap_join, path_prefixes, range_join
from harborline.operators.ordered import (
    asof_join,
    peer_ranks,
    rows_frame,
    running,
    trailing_extrema,
    trailing_sum,
    with_group_columns,
)
from harborline.operators.quantiles import exact_quantiles
from harborline.operators.sets import except_all, intersect_all
from harborline.operators.sql import run_sql, service_stats
from harborline.plans.registry import Tables, query
from harborline.session import literal_table, new_folder, stage
from harborline.sources.tables import write_bucketed


@query(
    "q2_service_stats",
    """
    SELECT event_type AS service_name, count(*) AS events, round(avg(value), 9) AS avg_cpu
    FROM events GROUP BY event_type
    """,
)
def q2_service_stats(t: Tables):
    stats = service_stats(t.events, "event_type", "value")
    return stats.select("service_name", "events", F.round("avg_cpu", 9).alias("avg_cpu"))


Q1_TEXT = """
SELECT n.n_name AS nation, count(*) AS customers, round(avg(c.c_acctbal), 9) AS avg_balance
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name
"""


@query("q1_run_sql", Q1_TEXT.format(customer="customer", nation="nation"))
def q1_run_sql(t: Tables):
    t.customer.createOrReplaceTempView("customer")
    t.nation.createOrReplaceTempView("nation")
    return run_sql(t.spark, Q1_TEXT.format(customer="customer", nation="nation"))


# -- scan, projection, filter ---------------------------------------------------------------------


@query("b01_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def b01_scan(t: Tables):
    return t.part


@query(
    "b02_projection_case_cast",
    """
    SELECT o_orderkey, o_custkey AS customer,
           CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium'
                ELSE 'small' END AS order_size,
           CAST(floor(o_totalprice) AS BIGINT) AS whole_price,
           CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority
    FROM orders
    """,
)
def b02_projection_case_cast(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("customer"),
        F.when(price >= 300000, "large").when(price >= 100000, "medium").otherwise("small").alias("order_size"),
        F.floor(price).cast("bigint").alias("whole_price"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
    )


@query(
    "b03_filter_predicates",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'
      AND l_quantity IS NOT NULL
    """,
)
def b03_filter_predicates(t: Tables):
    return t.lineitem.where(
        (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01'"))
        & (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1998-01-01'"))
        & F.col("l_discount").between(0.05, 0.07)
        & F.col("l_returnflag").isin("A", "R")
        & F.col("l_linestatus").like("F%")
        & F.col("l_quantity").isNotNull()
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


# -- joins ------------------------------------------------------------------------------------------


@query(
    "b04_inner_equi_join",
    """
    SELECT c.c_mktsegment AS segment, n.n_name AS nation, count(*) AS line_items,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
    GROUP BY c.c_mktsegment, n.n_name
    """,
)
def b04_inner_equi_join(t: Tables):
    """Line items are summed per order before they move."""
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price")
    )
    return (
        lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
        .agg(F.sum("n").alias("line_items"), F.sum("price").cast("double").alias("revenue"))
    )


def _line_counts(t: Tables):
    """Line items per order: makes the join key unique before an outer join."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line_items"))


_LINE_COUNTS = "(SELECT l_orderkey, count(*) AS line_items FROM lineitem GROUP BY l_orderkey)"


@query(
    "b05_left_outer_join",
    f"""
    SELECT o_orderkey, coalesce(line_items, 0) AS line_items FROM orders
    LEFT JOIN {_LINE_COUNTS} ON o_orderkey = l_orderkey
    """,
)
def b05_left_outer_join(t: Tables):
    return t.orders.join(_line_counts(t), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.coalesce("line_items", F.lit(0)).alias("line_items")
    )


_CUSTOMER_ORDERS = "(SELECT o_custkey, count(*) AS placed FROM orders GROUP BY o_custkey)"


@query(
    "b05_right_outer_join",
    f"""
    SELECT c_custkey, coalesce(placed, 0) AS placed FROM {_CUSTOMER_ORDERS}
    RIGHT JOIN customer ON o_custkey = c_custkey
    """,
)
def b05_right_outer_join(t: Tables):
    placed = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("placed"))
    return placed.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select(
        "c_custkey", F.coalesce("placed", F.lit(0)).alias("placed")
    )


@query(
    "b05_full_outer_join",
    """
    SELECT coalesce(u, c) AS id, user_events, customer_orders
    FROM (SELECT user_id AS u, count(*) AS user_events FROM events GROUP BY user_id)
    FULL JOIN (SELECT o_custkey AS c, count(*) AS customer_orders FROM orders GROUP BY o_custkey) ON u = c
    """,
)
def b05_full_outer_join(t: Tables):
    users = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("user_events"))
    buyers = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("customer_orders"))
    return users.join(buyers, "id", "full")


@query(
    "b06_semi_join_exists",
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    """,
)
def b06_semi_join_exists(t: Tables):
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query(
    "b06_anti_join_not_exists",
    """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def b06_anti_join_not_exists(t: Tables):
    shipped = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.join(shipped, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query(
    "b06_not_in",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def b06_not_in(t: Tables):
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("toxic_id"))
    return not_in(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", toxic, "toxic_id")


_BANDS = [("small", 1.0, 11.0), ("medium", 11.0, 31.0), ("large", 31.0, 51.0), ("odd", 5.0, 15.0)]
_BANDS_SQL = ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in _BANDS)


@query(
    "b07_range_join",
    f"""
    SELECT band, count(*) AS parts, round(avg(p_retailprice), 9) AS avg_price
    FROM part JOIN (VALUES {_BANDS_SQL}) AS bands(band, low, high) ON p_size >= low AND p_size < high
    GROUP BY band
    """,
)
def b07_range_join(t: Tables):
    bands = literal_table(t.spark, _BANDS, "band string, low double, high double")
    return (
        range_join(t.part, bands, "p_size", "low", "high", width=10.0)
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_retailprice"), 9).alias("avg_price"))
    )


_SHIPPING = """
SELECT o_custkey AS cust, l_orderkey, l_linenumber, o_orderkey
FROM (SELECT o_custkey AS c, l_orderkey, l_linenumber, l_shipdate AS s, l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS e
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
JOIN orders ON c = o_custkey AND o_orderkey <> l_orderkey AND s < o_orderdate + INTERVAL 30 DAY AND o_orderdate < e AND s < e
"""


def _days(column):
    return F.unix_micros(F.col(column).cast("timestamp")) / 86_400_000_000.0


@query("b07_overlap_join", _SHIPPING)
def b07_overlap_join(t: Tables):
    """Line items under way (a day per piece from shipping) while another order of the same customer was open (30 days)."""
    way = [_days("l_shipdate").alias("s"), (_days("l_shipdate") + F.col("l_quantity").cast("int")).alias("e")]
    sent = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("cust"), "l_orderkey", "l_linenumber", *way
    )
    opened = t.orders.select(F.col("o_custkey").alias("cust"), "o_orderkey", _days("o_orderdate").alias("o"), (_days("o_orderdate") + 30).alias("c"))
    pairs = overlap_join(sent, opened, ("s", "e"), ("o", "c"), 16.0, ["cust"], left_sizes=t.lineitem.select(*way))
    return pairs.where(F.col("o_orderkey") != F.col("l_orderkey")).select("cust", "l_orderkey", "l_linenumber", "o_orderkey")


@query(
    "b07_overlap_join_without_key",
    """
    SELECT p.p_partkey, band FROM part p
    JOIN (SELECT o_orderkey AS band, o_totalprice / 128 AS low, o_totalprice / 128 + 0.25 AS high FROM orders) b
      ON p.p_retailprice - 0.25 < high AND low < p.p_retailprice
    """,
)
def b07_overlap_join_without_key(t: Tables):
    """Price ranges below parts that overlap ranges above order totals over 128: two inequalities and no equality."""
    below = t.part.select("p_partkey", (F.col("p_retailprice") - 0.25).alias("a"), F.col("p_retailprice").alias("b"))
    bands = t.orders.select(F.col("o_orderkey").alias("band"), (F.col("o_totalprice") / 128).alias("low"), (F.col("o_totalprice") / 128 + 0.25).alias("high"))
    return overlap_join(below, bands, ("a", "b"), ("low", "high"), 0.25).select("p_partkey", "band")


_BUCKETED = """
SELECT o_orderkey, o_orderpriority, count(*) AS line_items, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority
"""


@query("b08_bucketed_join", _BUCKETED)
def b08_bucketed_join(t: Tables):
    """Both tables bucketed and sorted by the order: the join and the grouping move no row."""
    buckets = max(8, t.spark.sparkContext.defaultParallelism)
    label = uuid.uuid4().hex
    items, orders = (
        write_bucketed(df, f"bucketed_{name}_{label}", new_folder(t.spark, name), [key], buckets)
        for df, name, key in (
            (t.lineitem.select("l_orderkey", "l_linenumber"), "lineitem", "l_orderkey"), (t.orders.select("o_orderkey", "o_orderpriority"), "orders", "o_orderkey"),
        )
    )
    joined = items.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("line_items"), F.sum("l_linenumber").alias("line_numbers"))


@query(
    "b08_sort_merge_join",
    """
    SELECT o_orderpriority, count(*) AS line_items, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority
    """,
)
def b08_sort_merge_join(t: Tables):
    items = t.lineitem.select("l_orderkey", "l_linenumber")
    return (
        items.hint("merge")
        .join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("line_items"), F.sum("l_linenumber").alias("line_numbers"))
    )


@query(
    "b09_interval_join",
    """
    SELECT p.event_id AS purchase_id, e.event_id AS error_id,
           (epoch_us(e.ts) - epoch_us(p.ts)) // 1000 AS lag_ms
    FROM events p JOIN events e ON p.user_id = e.user_id
     AND e.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 6 HOUR
    WHERE p.event_type = 'purchase' AND e.event_type = 'error'
      AND epoch_us(e.ts) >= epoch_us(p.ts)
    UNION ALL
    SELECT p.event_id, e.event_id, -((epoch_us(p.ts) - epoch_us(e.ts)) // 1000)
    FROM events p JOIN events e ON p.user_id = e.user_id
     AND e.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 6 HOUR
    WHERE p.event_type = 'purchase' AND e.event_type = 'error'
      AND epoch_us(e.ts) < epoch_us(p.ts)
    """,
)
def b09_interval_join(t: Tables):
    purchases = t.events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts")
    )
    errors = t.events.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts")
    )
    joined = interval_join(purchases, errors, ["user_id"], "purchase_ts", "error_ts", 3600, 6 * 3600)
    micros = F.unix_micros(F.col("error_ts").cast("timestamp")) - F.unix_micros(F.col("purchase_ts").cast("timestamp"))
    return joined.select(
        "purchase_id", "error_id", F.expr("1").alias("_"), micros.alias("_us")
    ).select("purchase_id", "error_id", F.expr("_us DIV 1000").alias("lag_ms"))


@query(
    "b10_asof_join",
    """
    SELECT p.event_id, p.user_id, e.event_id AS error_id, e.value AS error_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e
      ON p.user_id = e.user_id AND p.ts >= e.ts
    """,
)
def b10_asof_join(t: Tables):
    purchases = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = t.events.where("event_type = 'error'").select(
        "user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value")
    )
    joined = asof_join(purchases, errors, ["user_id"], "ts", "ts", ["error_id", "error_value"])
    return joined.select("event_id", "user_id", "error_id", "error_value")


# -- aggregates -------------------------------------------------------------------------------------


@query(
    "b11_hash_aggregate",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
           round(avg(l_discount), 9) AS avg_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def b11_hash_aggregate(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
        F.round(F.avg("l_discount"), 9).alias("avg_discount"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )


@query(
    "b12_distinct_aggregates",
    """
    SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(DISTINCT user_id) AS BIGINT) AS user_sum,
           count(DISTINCT props) AS distinct_props, count(*) AS n
    FROM events GROUP BY event_type
    """,
)
def b12_distinct_aggregates(t: Tables):
    return distinct_aggregates(
        t.events, ["event_type"],
        {"users": ("count", "user_id"), "user_sum": ("sum", "user_id"), "distinct_props": ("count", "props")},
        {"n": F.count(F.lit(1))},
    )


@query(
    "b13_statistics",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop,
           round(var_samp(l_discount), 6) AS var_s, round(var_pop(l_quantity), 6) AS var_p,
           round(corr(l_quantity, l_extendedprice), 6) AS r,
           round(covar_samp(l_quantity, l_discount), 6) AS cov_s,
           round(covar_pop(l_quantity, l_tax), 6) AS cov_p,
           round(regr_slope(l_tax, l_quantity), 6) AS slope, round(regr_r2(l_tax, l_quantity), 6) AS r2,
           round(regr_avgx(l_tax, l_quantity), 6) AS avg_x, round(regr_avgy(l_tax, l_quantity), 6) AS avg_y,
           CAST(regr_count(l_tax, l_quantity) AS BIGINT) AS pairs
    FROM lineitem GROUP BY l_returnflag
    """,
)
def b13_statistics(t: Tables):
    def r6(column):
        return F.round(column, 6)

    return t.lineitem.groupBy("l_returnflag").agg(
        r6(F.stddev_samp("l_quantity")).alias("sd"), r6(F.stddev_pop("l_quantity")).alias("sd_pop"),
        r6(F.var_samp("l_discount")).alias("var_s"), r6(F.var_pop("l_quantity")).alias("var_p"),
        r6(F.corr("l_quantity", "l_extendedprice")).alias("r"),
        r6(F.covar_samp("l_quantity", "l_discount")).alias("cov_s"),
        r6(F.covar_pop("l_quantity", "l_tax")).alias("cov_p"),
        r6(F.regr_slope("l_tax", "l_quantity")).alias("slope"), r6(F.regr_r2("l_tax", "l_quantity")).alias("r2"),
        r6(F.regr_avgx("l_tax", "l_quantity")).alias("avg_x"), r6(F.regr_avgy("l_tax", "l_quantity")).alias("avg_y"),
        F.regr_count("l_tax", "l_quantity").alias("pairs"),
    )


@query(
    "b14_exact_quantiles",
    """
    SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25,
           round(quantile_cont(value, 0.99), 6) AS q99
    FROM events GROUP BY event_type
    """,
)
def b14_exact_quantiles(t: Tables):
    found = exact_quantiles(t.events, ["event_type"], "value", {"median": 0.5, "q25": 0.25, "q99": 0.99})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "q25", "q99")])


@query(
    "b14_approx_aggregates",
    """
    SELECT event_type, count(DISTINCT user_id) AS exact_users, true AS users_close,
           count(*) FILTER (WHERE value IS NOT NULL) AS n, true AS median_close, true AS p90_close
    FROM events GROUP BY event_type
    """,
)
def b14_approx_aggregates(t: Tables):
    """Sketches beside exact counts; a sketched quantile is close if its exact rank is within a hundredth."""
    sketched = t.events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users"), F.count("value").alias("n"),
        F.kll_sketch_agg_double("value", F.lit(2000)).alias("s"),
    )
    marks = stage(sketched.select(
        "event_type", "users", "n", *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(c) for c, p in (("p50", 0.5), ("p90", 0.9))]
    ), "sketched")
    exact = distinct_aggregates(t.events, ["event_type"], {"exact_users": ("count", "user_id")}, {})
    ranks = with_group_columns(t.events.select("event_type", "value"), marks.select("event_type", "p50", "p90"), ["event_type"]).groupBy("event_type").agg(
        F.count_if(F.col("value") <= F.col("p50")).alias("upto50"), F.count_if(F.col("value") <= F.col("p90")).alias("upto90")
    )
    every = with_group_columns(with_group_columns(marks, exact, ["event_type"]), ranks, ["event_type"])
    return every.select(
        "event_type", "exact_users", (F.abs(F.col("users") - F.col("exact_users")) <= 0.1 * F.col("exact_users")).alias("users_close"), "n",
        (F.abs(F.col("upto50") / F.col("n") - 0.5) <= 0.01 + 1 / F.col("n")).alias("median_close"),
        (F.abs(F.col("upto90") / F.col("n") - 0.9) <= 0.01 + 1 / F.col("n")).alias("p90_close"),
    )


@query(
    "b15_ordered_lists_and_filter",
    """
    SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds,
           string_agg(DISTINCT event_type, '|' ORDER BY event_type DESC) AS kinds_desc,
           max_by(value, ts) AS last_value, min_by(event_type, ts) AS first_type,
           count(*) FILTER (WHERE value > 50) AS above_50,
           bool_or(value > 200) AS any_200, bool_and(value > 0.5) AS all_half,
           bit_and(event_id) AS bits_and, bit_or(event_id) AS bits_or, bit_xor(event_id) AS bits_xor
    FROM events GROUP BY user_id
    """,
)
def b15_ordered_lists_and_filter(t: Tables):
    """Lists hold distinct event types only, so a hot user cannot make them long."""
    kinds = F.array_sort(F.collect_set("event_type"))
    return t.events.groupBy("user_id").agg(
        F.array_join(kinds, ",").alias("kinds"),
        F.array_join(F.reverse(kinds), "|").alias("kinds_desc"),
        F.max_by("value", "ts").alias("last_value"), F.min_by("event_type", "ts").alias("first_type"),
        F.count_if(F.col("value") > 50).alias("above_50"),
        F.bool_or(F.col("value") > 200).alias("any_200"), F.bool_and(F.col("value") > 0.5).alias("all_half"),
        F.bit_and("event_id").alias("bits_and"), F.bit_or("event_id").alias("bits_or"),
        F.bit_xor("event_id").alias("bits_xor"),
    )


_CUBE = """
SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS order_year, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(grouping(o_orderstatus) AS BIGINT) AS g_status, CAST(grouping(o_orderpriority) AS BIGINT) AS g_priority
FROM {orders} GROUP BY {spec}
"""
_YEARLESS = _CUBE.replace("year(o_orderdate) AS order_year, ", "")


_STATUS = ["o_orderstatus", "o_orderpriority"]


def _priced(t: Tables, sets):
    """Order counts and totals for grouping sets of status and priority, from the finest aggregate."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    found = grouping_sets(t.orders, _STATUS, sets, {"n": ("count", F.lit(1)), "total": ("sum", price)})
    return found.select(
        *_STATUS, "n", F.col("total").cast("double").alias("total"),
        F.col("g_o_orderstatus").alias("g_status"), F.col("g_o_orderpriority").alias("g_priority"),
    )


@query("b16_cube", _YEARLESS.format(orders="orders", spec="CUBE (o_orderstatus, o_orderpriority)"))
def b16_cube(t: Tables):
    return _priced(t, cube_sets(_STATUS))


@query("b16_rollup", _YEARLESS.format(orders="orders", spec="ROLLUP (o_orderstatus, o_orderpriority)"))
def b16_rollup(t: Tables):
    return _priced(t, rollup_sets(_STATUS))


_SETS = "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"


@query("b16_grouping_sets", _YEARLESS.format(orders="orders", spec=_SETS))
def b16_grouping_sets(t: Tables):
    return _priced(t, [["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], []])


@query(
    "b17_having_and_group_expression",
    """
    SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS price_band, count(*) AS n, max(o_totalprice) AS top
    FROM orders GROUP BY CAST(floor(o_totalprice / 50000) AS BIGINT) HAVING count(*) > 1000
    """,
)
def b17_having_and_group_expression(t: Tables):
    return (
        t.orders.groupBy(F.floor(F.col("o_totalprice") / 50000).alias("price_band"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
        .where("n > 1000")
    )


# -- windows ----------------------------------------------------------------------------------------


@query(
    "b18_row_number_and_ntile",
    """
    SELECT o_orderkey, row_number() OVER w AS rn, CAST(ntile(4) OVER w AS BIGINT) AS quartile
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)
    """,
)
def b18_row_number_and_ntile(t: Tables):
    priced = t.orders.select("o_orderkey", "o_orderstatus", (-F.col("o_totalprice")).alias("cheaper"))
    placed = running(
        priced, ["o_orderstatus"], ["cheaper", "o_orderkey"],
        {"rn": ("count", F.lit(1)), "n": ("group_count", F.lit(1))},
    )
    # The first n % 4 tiles hold one row more than the others.
    small, extra = F.expr("n DIV 4"), F.col("n") % 4
    wide = extra * (small + 1)
    tile = F.when(F.col("rn") <= wide, F.expr("(rn - 1) DIV (n DIV 4 + 1)")).otherwise(
        extra + F.expr("(rn - 1 - (n % 4) * (n DIV 4 + 1)) DIV greatest(n DIV 4, 1)")
    )
    return placed.select("o_orderkey", "rn", (tile + 1).alias("quartile"))


@query(
    "b18_rank_family",
    """
    SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense,
           round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)
    """,
)
def b18_rank_family(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    ranks = peer_ranks(orders, ["o_orderpriority"], ["o_orderdate"])
    return with_group_columns(orders, ranks, ["o_orderpriority", "o_orderdate"]).select(
        "o_orderkey", F.col("rank").alias("rnk"), F.col("dense_rank").alias("dense"),
        F.round("percent_rank", 6).alias("pct"), F.round("cume_dist", 6).alias("cume"),
    )


@query(
    "b19_lag_lead_nth",
    """
    SELECT event_id, lag(value) OVER w AS previous, lead(value, 2) OVER w AS after_next,
           first_value(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS first_of_5,
           last_value(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS last_of_5,
           nth_value(value, 2) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS second_of_5
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
    """,
)
def b19_lag_lead_nth(t: Tables):
    return rows_frame(
        t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], 2, 2,
        {
            "previous": lambda w: F.lag("value").over(w),
            "after_next": lambda w: F.lead("value", 2).over(w),
            "first_of_5": lambda w: F.first("value").over(w.rowsBetween(-2, 2)),
            "last_of_5": lambda w: F.last("value").over(w.rowsBetween(-2, 2)),
            "second_of_5": lambda w: F.nth_value("value", 2).over(w.rowsBetween(-2, 2)),
        },
    ).drop("event_type", "ts", "value")


@query(
    "b19_first_and_last_of_group",
    """
    SELECT event_id, event_type, first_value(value) OVER w AS opening, last_value(value) OVER w AS closing
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def b19_first_and_last_of_group(t: Tables):
    place = F.struct(F.col("ts").isNull(), "ts", F.col("event_id").isNull(), "event_id")
    edges = t.events.groupBy("event_type").agg(
        F.min_by("value", place).alias("opening"), F.max_by("value", place).alias("closing"),
    )
    # Written first, so that Spark joins by the measured size of this table.
    return with_group_columns(t.events.select("event_id", "event_type"), stage(edges, "edges"), ["event_type"])


@query(
    "b20_rows_frame",
    """
    SELECT event_id, round(avg(value) OVER w, 6) AS moving_avg, max(value) OVER w AS moving_max,
           count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)
    """,
)
def b20_rows_frame(t: Tables):
    return rows_frame(
        t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], 3, 1,
        {
            "moving_avg": lambda w: F.round(F.avg("value").over(w.rowsBetween(-3, 1)), 6),
            "moving_max": lambda w: F.max("value").over(w.rowsBetween(-3, 1)),
            "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-3, 1)),
        },
    ).drop("user_id", "ts", "value")


@query(
    "b20_range_frame",
    """
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS day_sum, count(*) OVER w AS day_count
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts
                             RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
    """,
)
def b20_range_frame(t: Tables):
    summed = trailing_sum(
        t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", 86400,
        F.round(F.col("value") * 100).cast("bigint"), "day_cents", "day_count",
    )
    return summed.select("event_id", (F.col("day_cents") / 100.0).alias("day_sum"), "day_count")


@query(
    "b20_range_extrema",
    """
    SELECT event_id, min(value) OVER w AS day_min, max(value) OVER w AS day_max
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts
                             RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
    """,
)
def b20_range_extrema(t: Tables):
    found = trailing_extrema(
        t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", 86400, F.col("value"), "day_min", "day_max"
    )
    return found.select("event_id", "day_min", "day_max")


@query(
    "b20_running_total",
    """
    SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS spent,
           max(o_totalprice) OVER w AS largest_so_far
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def b20_running_total(t: Tables):
    totals = running(
        t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"),
        ["o_orderstatus"], ["o_orderdate", "o_orderkey"],
        {"spent": ("sum", F.col("o_totalprice").cast("decimal(18,2)")),
         "largest_so_far": ("max", F.col("o_totalprice"))},
    )
    return totals.select("o_orderkey", F.col("spent").cast("double").alias("spent"), "largest_so_far")


@query(
    "b20_groups_frame",
    """
    SELECT o_orderkey, count(*) OVER w AS orders_in_frame,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS price_in_frame
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate
                             GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)
    """,
)
def b20_groups_frame(t: Tables):
    """Peers are summed first; a frame of peer groups is then a frame of rows."""
    peers = t.orders.groupBy("o_orderstatus", "o_orderdate").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s")
    )
    framed = rows_frame(
        peers, ["o_orderstatus"], ["o_orderdate"], 1, 0,
        {"orders_in_frame": lambda w: F.sum("c").over(w.rowsBetween(-1, 0)),
         "price_in_frame": lambda w: F.sum("s").over(w.rowsBetween(-1, 0)).cast("double")},
    )
    return with_group_columns(t.orders, framed, ["o_orderstatus", "o_orderdate"]).select(
        "o_orderkey", "orders_in_frame", "price_in_frame"
    )


# -- order, sets, subqueries ------------------------------------------------------------------------


@query(
    "b21_top_k_with_offset",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 20
    """,
)
def b21_top_k_with_offset(t: Tables):
    return (
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(20).limit(100)
    )


def _ids(t: Tables):
    return t.documents.select("doc_id"), t.labels.select("doc_id")


@query(
    "b22_union_all",
    "SELECT doc_id, 'document' AS origin FROM documents UNION ALL SELECT doc_id, 'label' AS origin FROM labels",
)
def b22_union_all(t: Tables):
    documents, labels = _ids(t)
    return documents.withColumn("origin", F.lit("document")).unionByName(labels.withColumn("origin", F.lit("label")))


@query("b22_union_distinct", "SELECT l_partkey AS partkey FROM lineitem UNION SELECT p_partkey FROM part")
def b22_union_distinct(t: Tables):
    return t.lineitem.select(F.col("l_partkey").alias("partkey")).union(t.part.select("p_partkey")).distinct()


@query("b22_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def b22_intersect(t: Tables):
    documents, labels = _ids(t)
    return documents.intersect(labels)


@query("b22_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def b22_except(t: Tables):
    documents, labels = _ids(t)
    return documents.subtract(labels)


@query(
    "b22_intersect_all",
    """
    SELECT role FROM conversations WHERE turn < 2 INTERSECT ALL SELECT role FROM conversations WHERE turn >= 1
    """,
)
def b22_intersect_all(t: Tables):
    return intersect_all(*_early_and_late_roles(t))


@query(
    "b22_except_all",
    """
    SELECT role FROM conversations WHERE turn < 2 EXCEPT ALL SELECT role FROM conversations WHERE turn >= 1
    """,
)
def b22_except_all(t: Tables):
    return except_all(*_early_and_late_roles(t))


def _early_and_late_roles(t: Tables):
    return t.conversations.where("turn < 2").select("role"), t.conversations.where("turn >= 1").select("role")


@query(
    "b23_scalar_subquery",
    """
    SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 3000 FROM customer)
    """,
)
def b23_scalar_subquery(t: Tables):
    return t.sql(
        """
        SELECT c_custkey, c_acctbal FROM {customer}
        WHERE c_acctbal > (SELECT avg(c_acctbal) + 3000 FROM {customer})
        """, "customer",
    )


@query(
    "b23_correlated_subquery",
    """
    SELECT l_partkey, count(*) AS small_lines, CAST(sum(l_quantity) AS DOUBLE) AS qty
    FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)
    GROUP BY l_partkey
    """,
)
def b23_correlated_subquery(t: Tables):
    return t.sql(
        """
        SELECT l_partkey, count(*) AS small_lines, sum(l_quantity) AS qty
        FROM {lineitem} l
        WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)
        GROUP BY l_partkey
        """, "lineitem",
    )


@query(
    "b23_in_subquery",
    """
    SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (
        SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'
        GROUP BY l_suppkey HAVING sum(l_quantity) > 1000)
    """,
)
def b23_in_subquery(t: Tables):
    return t.sql(
        """
        SELECT s_suppkey, s_name FROM {supplier} WHERE s_suppkey IN (
            SELECT l_suppkey FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'
            GROUP BY l_suppkey HAVING sum(l_quantity) > 1000)
        """, "supplier", "lineitem", "part",
    )


_CTE = """
WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM {orders} GROUP BY o_custkey),
     segment AS (SELECT c_mktsegment, avg(CAST(total AS DOUBLE)) AS mean FROM spend JOIN {customer} ON o_custkey = c_custkey
                 GROUP BY c_mktsegment)
SELECT c_custkey, CAST(total AS DOUBLE) AS total, round(CAST(total AS DOUBLE) / mean, 6) AS share_of_mean
FROM spend JOIN {customer} ON o_custkey = c_custkey JOIN segment USING (c_mktsegment)
"""


@query("b24_cte", _CTE.format(orders="orders", customer="customer"))
def b24_cte(t: Tables):
    return t.sql(_CTE, "orders", "customer")


_ANCESTORS = """
WITH RECURSIVE up(page_id, path, steps) AS (
    SELECT page_id, rtrim({strip}, '/'), 0 FROM {pages}
    UNION ALL
    SELECT page_id, regexp_replace(path, '/[^/]*$', ''), steps + 1 FROM up WHERE contains(path, '/'))
SELECT page_id, path, CAST(steps AS BIGINT) AS steps FROM up
"""
_ANCESTORS_SQL = _ANCESTORS.format(strip="regexp_replace(url, '^[a-z]+://', '')", pages="pages")


@query("b24_recursive_cte", _ANCESTORS_SQL)
def b24_recursive_cte(t: Tables):
    """Ancestors of each page by recursion; the steps are bounded by the depth of a path."""
    # The defaults allow a million rows and a hundred steps, which a large table or a deep path exceeds.
    # The settings count when the plan runs, so they go to a session of this query's own.
    own = Tables(t.spark.newSession(), t.root)
    depth = own.pages.agg(F.max(F.size(F.split("url", "/")))).first()[0] or 0
    own.spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    own.spark.conf.set("spark.sql.cteRecursionLevelLimit", max(100, depth + 1))
    stripped = "rtrim('/', regexp_replace(url, '^[a-z]+://', ''))"
    return own.sql(_ANCESTORS.replace("rtrim({strip}, '/')", stripped), "pages")


@query(
    "b24_recursion_over_parents",
    """
    WITH RECURSIVE parents AS (
        SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id FROM events),
    down(node, root, depth) AS (
        SELECT event_id, event_id, CAST(0 AS BIGINT) FROM parents WHERE parent_id IS NULL
        UNION ALL
        SELECT p.event_id, d.root, d.depth + 1 FROM down d JOIN parents p ON p.parent_id = d.node)
    SELECT node, root, depth FROM down
    """,
)
def b24_recursion_over_parents(t: Tables):
    """Events as a chain of snapshots per user, each naming the one before: first snapshot and number of steps to it."""
    chained = rows_frame(
        t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 1, 0,
        {"parent_id": lambda w: F.lag("event_id").over(w)},
    )
    return roots(chained, "event_id", "parent_id")


@query("b24_ancestors_without_recursion", _ANCESTORS_SQL)
def b24_ancestors_without_recursion(t: Tables):
    """The same rows in one pass: the steps depend on no other row, so each is spelled out in place."""
    site = F.rtrim(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"))
    return t.pages.select("page_id", F.posexplode_outer(F.reverse(path_prefixes(site))).alias("steps", "path")).select(
        "page_id", "path", F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps")
    )


@query(
    "b25_unnest",
    """
    SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS top
    FROM (SELECT unnest(generate_series(1, CAST(len(embedding) AS BIGINT))) AS dim,
                 CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    GROUP BY dim
    """,
)
def b25_unnest(t: Tables):
    return (
        t.embeddings.select(F.posexplode("embedding").alias("pos", "x"))
        .groupBy((F.col("pos") + 1).cast("bigint").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"),
             F.round(F.max(F.col("x").cast("double")), 6).alias("top"))
    )


@query(
    "b25_values_join",
    """
    SELECT urgency, count(*) AS orders_placed FROM orders
    JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'now'), ('3-MEDIUM', 'soon'), ('5-LOW', 'later'))
         AS v(priority, urgency) ON o_orderpriority = priority
    GROUP BY urgency
    """,
)
def b25_values_join(t: Tables):
    return t.sql(
        """
        SELECT urgency, count(*) AS orders_placed FROM {orders}
        JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'now'), ('3-MEDIUM', 'soon'), ('5-LOW', 'later'))
             AS v(priority, urgency) ON o_orderpriority = priority
        GROUP BY urgency
        """, "orders",
    )


@query(
    "b25_generate_series",
    """
    SELECT o_orderstatus, day, count(*) AS open_orders
    FROM (SELECT o_orderstatus, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS day
          FROM orders) GROUP BY o_orderstatus, day
    """,
)
def b25_generate_series(t: Tables):
    days = F.explode(F.expr("sequence(o_orderdate, o_orderdate + INTERVAL 2 DAYS, INTERVAL 1 DAY)"))
    return t.orders.select("o_orderstatus", days.alias("day")).groupBy("o_orderstatus", "day").agg(
        F.count(F.lit(1)).alias("open_orders")
    )
