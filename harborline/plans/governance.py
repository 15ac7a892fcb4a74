"""Request rules, directory search, leases and tickets over mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import governance as gov
from harborline.plans.registry import Tables, query
from harborline.session import literal_table, new_folder

_REQUESTS = """
SELECT p_partkey, p_size AS cores, p_partkey % 10 = 0 AS root, p_partkey % 7 = 0 AS privileged FROM part
"""
_TEXTS = f"""
SELECT p_partkey, array_to_string(list_filter([
    CASE WHEN privileged THEN '{gov.PRIVILEGED_TEXT}' END, CASE WHEN root THEN '{gov.ROOT_TEXT}' END,
    CASE WHEN cores > 32 THEN 'Requested CPU cores (' || cores || ') exceeds policy limit of 32.' END],
    lambda x: x IS NOT NULL), '|') AS violations,
    NOT (privileged OR root OR cores > 32) AS allowed
FROM ({_REQUESTS})
"""


@query("g1_validate_requests", _TEXTS)
def g1_validate_requests(t: Tables):
    requests = t.part.select(
        "p_partkey", F.col("p_size").alias("cpu_cores"), (F.col("p_partkey") % 10).alias("run_as_user"),
        (F.col("p_partkey") % 7 == 0).alias("privileged"),
    )
    return gov.validate_requests(requests).select(
        "p_partkey", F.array_join("violations", "|").alias("violations"), "allowed"
    )


@query(
    "g2_policy_table",
    "SELECT p_brand AS name, 'ClusterPolicy' AS kind, CAST(max(p_size) AS BIGINT) AS max_cores FROM part GROUP BY p_brand",
)
def g2_policy_table(t: Tables):
    path = new_folder(t.spark, "policies")
    limits = t.part.groupBy("p_brand").agg(F.max("p_size").alias("max_cores"))
    gov.apply_policies(
        limits.select(
            F.col("p_brand").alias("name"), F.lit("ClusterPolicy").alias("kind"),
            F.to_json(F.struct("max_cores")).alias("spec"),
        ),
        path,
    )
    listed = gov.list_policies(t.spark, path)
    return listed.select("name", "kind", F.from_json("spec", "max_cores bigint")["max_cores"].alias("max_cores"))


@query(
    "g3_search_users",
    """
    SELECT c_custkey FROM customer WHERE contains(c_name, 'mach') OR contains(lower(c_mktsegment), 'mach')
    """,
)
def g3_search_users(t: Tables):
    return gov.search_users(t.customer, "mach", "c_name", "c_mktsegment").select("c_custkey")


_GROUPS = """
SELECT c_custkey, ['cn=' || lower(c_mktsegment) || ',cn=groups,dc=corp', 'ou=people,dc=corp',
                   'cn=nation-' || c_nationkey || ',cn=groups'] AS member_of FROM customer
"""


def _members(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.array(
            F.concat(F.lit("cn="), F.lower("c_mktsegment"), F.lit(",cn=groups,dc=corp")), F.lit("ou=people,dc=corp"),
            F.concat(F.lit("cn=nation-"), F.col("c_nationkey").cast("string"), F.lit(",cn=groups")),
        ).alias("member_of"),
    ).withColumn("groups", gov.group_names(F.col("member_of")))


@query(
    "g4_group_names",
    f"""
    SELECT c_custkey, array_to_string(list_transform(list_filter(member_of, lambda m: starts_with(m, 'cn=')),
           lambda m: substr(split_part(m, ',', 1), 4)), '|') AS groups FROM ({_GROUPS})
    """,
)
def g4_group_names(t: Tables):
    return _members(t).select("c_custkey", F.array_join("groups", "|").alias("groups"))


@query(
    "g5_authorize_groups",
    "SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) OR coalesce(c_nationkey = 3, false) AS authorized FROM customer",
)
def g5_authorize_groups(t: Tables):
    allowed = ["building", "machinery", "nation-3"]
    return gov.authorize_groups(_members(t), "groups", allowed).select("c_custkey", "authorized")


# The roles leases are issued for, with default and maximum lifetime in seconds.
ROLES = [
    ("spark-readonly", "analytics_warehouse", 300, 3600),
    ("airflow-writer", "analytics_warehouse", 600, 7200),
]
_ROLES_SQL = ", ".join(f"('{r}', '{d}', {lo}, {hi})" for r, d, lo, hi in ROLES)
NOW = "2024-01-30 12:00:00"


def roles(t: Tables):
    return literal_table(
        t.spark, ROLES, "role_name string, db_name string, default_ttl_secs bigint, max_ttl_secs bigint"
    )


def lease_requests(events):
    return events.select(
        F.col("event_id").alias("lease_id"),
        F.when(F.col("event_id") % 2 == 0, "spark-readonly").otherwise("airflow-writer").alias("role"),
        F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") * 60) + 1).alias("requested_ttl"),
        F.col("ts").alias("issue_time"),
    )


def leases(t: Tables):
    return gov.issue_leases(lease_requests(t.events), roles(t))[0]


LEASES_SQL = f"""
SELECT *, issue_time + ttl_secs * INTERVAL 1 SECOND AS expire_time FROM (
    SELECT lease_id, role, db_name, issue_time, least(coalesce(requested_ttl, default_ttl), max_ttl) AS ttl_secs
    FROM (SELECT event_id AS lease_id, CASE WHEN event_id % 2 = 0 THEN 'spark-readonly' ELSE 'airflow-writer' END AS role,
                 CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 60) AS BIGINT) + 1 END AS requested_ttl, ts AS issue_time FROM events)
    JOIN (SELECT role_name, db_name, CAST(d AS BIGINT) AS default_ttl, CAST(m AS BIGINT) AS max_ttl FROM (VALUES {_ROLES_SQL}) AS r(role_name, db_name, d, m)) ON role = role_name)
"""


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


@query("g6_issue_leases", f"SELECT lease_id, role, db_name, issue_time, expire_time, ttl_secs FROM ({LEASES_SQL})")
def g6_issue_leases(t: Tables):
    return leases(t)


@query(
    "g6_rejected_requests",
    """
    SELECT event_id AS lease_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'role ''' || event_type || ''' not configured'
           ELSE 'requested lifetime must be positive' END AS reason
    FROM events WHERE event_type NOT IN ('view', 'click') OR floor(value) <= 0
    """,
)
def g6_rejected_requests(t: Tables):
    requests = t.events.select(
        F.col("event_id").alias("lease_id"), F.col("event_type").alias("role"),
        F.floor("value").alias("requested_ttl"), F.col("ts").alias("issue_time"),
    )
    known = t.events.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_type").alias("role_name"), F.lit("warehouse").alias("db_name"),
        F.lit(300).cast("bigint").alias("default_ttl_secs"), F.lit(3600).cast("bigint").alias("max_ttl_secs"),
    ).distinct()
    return gov.issue_leases(requests, known)[1].select("lease_id", "reason")


_STAYING = """
SELECT o_orderkey AS lease_id, 'kept' AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL
SELECT c_custkey + 1000000000, 'unknown' FROM customer
"""


@query("g7_revoke_leases", _STAYING)
def g7_revoke_leases(t: Tables):
    issued = t.orders.select(F.col("o_orderkey").alias("lease_id"))
    revoked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("lease_id")).unionByName(
        t.customer.select((F.col("c_custkey") + 1_000_000_000).alias("lease_id"))
    )
    kept, unknown = gov.revoke_leases(issued, revoked)
    return kept.withColumn("state", F.lit("kept")).unionByName(unknown.withColumn("state", F.lit("unknown")))


@query("g8_expire_leases", f"SELECT lease_id, expire_time FROM ({LEASES_SQL}) WHERE expire_time <= TIMESTAMP '{NOW}'")
def g8_expire_leases(t: Tables):
    return gov.expire_leases(leases(t), now()).select("lease_id", "expire_time")


@query(
    "g9_active_leases",
    f"""
    SELECT lease_id, greatest(0, (epoch_us(expire_time) - epoch_us(TIMESTAMP '{NOW}')) // 1000000) AS remaining_secs
    FROM ({LEASES_SQL}) WHERE expire_time > TIMESTAMP '{NOW}'
    """,
)
def g9_active_leases(t: Tables):
    return gov.active_leases(leases(t), now()).select("lease_id", "remaining_secs")


@query(
    "g10_role_users",
    f"""
    SELECT 'v-token-' || replace(role, '-', '_') || '-' || lease_id AS username,
           'CONNECT ON ' || db_name || '|SELECT ON ALL TABLES' AS privileges, expire_time AS valid_until
    FROM ({LEASES_SQL}) WHERE expire_time > TIMESTAMP '{NOW}'
    """,
)
def g10_role_users(t: Tables):
    return gov.role_users(leases(t), now()).withColumn("privileges", F.array_join("privileges", "|"))


TICKETS_SQL = """
SELECT 'krbtgt/' || realm || '@' || realm AS server, client, start_time, start_time + INTERVAL 10 HOUR AS end_time,
       start_time + INTERVAL 70 HOUR AS renew_till
FROM (SELECT 'R' || user_id AS realm, event_type AS client, ts AS start_time,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1
"""


def current_tickets(t: Tables):
    requests = t.events.select(
        F.col("event_type").alias("client"), F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("realm"),
        F.col("ts").alias("start_time"),
    )
    return gov.current_tickets(gov.issue_tickets(requests, 36_000))


@query("g11_valid_tickets", f"SELECT *, end_time > TIMESTAMP '{NOW}' AS valid FROM ({TICKETS_SQL})")
def g11_valid_tickets(t: Tables):
    return gov.valid_tickets(current_tickets(t), now()).drop("realm")
