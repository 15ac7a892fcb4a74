import datetime as dt

from pyspark.sql import functions as F

from harborline.operators import governance as gov
from harborline.session import literal_table

T0 = dt.datetime(2024, 1, 1)
ROLES = [("reader", "db", 300, 3600)]
ROLE_SCHEMA = "role_name string, db_name string, default_ttl_secs bigint, max_ttl_secs bigint"


def requests(spark, rows):
    return literal_table(spark, rows, "lease_id string, role string, requested_ttl bigint, issue_time timestamp")


def test_rules_and_their_order(spark):
    rows = [("ok", False, 1, 32), ("cores", False, 1, 33), ("root", False, 0, 1), ("all", True, 0, 64)]
    df = literal_table(spark, rows, "name string, privileged boolean, run_as_user bigint, cpu_cores bigint")
    got = {r["name"]: (r["allowed"], r["violations"]) for r in gov.validate_requests(df).collect()}
    assert got["ok"] == (True, [])
    assert got["cores"] == (False, ["Requested CPU cores (33) exceeds policy limit of 32."])
    assert got["root"] == (False, [gov.ROOT_TEXT])
    assert got["all"] == (False, [gov.PRIVILEGED_TEXT, gov.ROOT_TEXT, "Requested CPU cores (64) exceeds policy limit of 32."])


def test_own_rules(spark):
    df = literal_table(spark, [(5,)], "n bigint")
    assert gov.validate_requests(df, [(F.col("n") > 4, F.lit("big"))]).first()["violations"] == ["big"]


def test_search_is_case_sensitive_for_uid_only(spark):
    df = literal_table(spark, [("admin", "Directory Administrator"), ("jdoe", "John Doe")], "uid string, full_name string")
    find = lambda q: sorted(r["uid"] for r in gov.search_users(df, q).collect())
    assert find("") == ["admin", "jdoe"]
    assert find("DOE") == ["jdoe"] and find("JDOE") == [] and find("dm") == ["admin"] and find("zz") == []


def test_group_names_and_access(spark):
    df = literal_table(spark, [(["cn=admins,cn=groups", "ou=x,cn=y", "cn=ops"],), ([],)], "m array<string>")
    named = df.select(gov.group_names(F.col("m")).alias("g"))
    assert [r["g"] for r in named.collect()] == [["admins", "ops"], []]
    assert [r["authorized"] for r in gov.authorize_groups(named, "g", ["ops", "none"]).collect()] == [True, False]


def test_lifetimes(spark):
    rows = [("default", "reader", None, T0), ("short", "reader", 60, T0), ("long", "reader", 9999, T0),
            ("zero", "reader", 0, T0), ("minus", "reader", -5, T0), ("who", "nobody", 60, T0)]
    leases, rejected = gov.issue_leases(requests(spark, rows), literal_table(spark, ROLES, ROLE_SCHEMA))
    assert {r["lease_id"]: r["ttl_secs"] for r in leases.collect()} == {"default": 300, "short": 60, "long": 3600}
    assert {r["lease_id"] for r in rejected.collect()} == {"zero", "minus", "who"}
    assert rejected.where("lease_id = 'who'").first()["reason"] == "role 'nobody' not configured"


def test_a_lease_ending_now_is_expired(spark):
    leases, _ = gov.issue_leases(requests(spark, [("a", "reader", 60, T0), ("b", "reader", 61, T0)]),
                                 literal_table(spark, ROLES, ROLE_SCHEMA))
    now = F.lit(T0 + dt.timedelta(seconds=60))
    assert [r["lease_id"] for r in gov.expire_leases(leases, now).collect()] == ["a"]
    assert [(r["lease_id"], r["remaining_secs"]) for r in gov.active_leases(leases, now).collect()] == [("b", 1)]
    user = gov.role_users(leases, now).first()
    assert (user["username"], user["privileges"]) == ("v-token-reader-b", ["CONNECT ON db", "SELECT ON ALL TABLES"])


def test_revoking_reports_unknown_leases(spark):
    leases = literal_table(spark, [("a",), ("b",)], "lease_id string")
    kept, unknown = gov.revoke_leases(leases, literal_table(spark, [("b",), ("x",), ("x",)], "lease_id string"))
    assert [r[0] for r in kept.collect()] == ["a"] and [r[0] for r in unknown.collect()] == ["x"]


def test_revoking_deals_ids_to_tasks_by_rows(spark, monkeypatch):
    """However few bytes the ids take, a task gets a bounded number of them; nulls and copies count as before."""
    monkeypatch.setattr(gov, "TASK_ROWS", 50, raising=False)
    leases = spark.range(1000).selectExpr("nullif(id, 7) AS lease_id").union(spark.range(2).selectExpr("8L"))
    revoked = spark.range(500, 1500).selectExpr("id AS lease_id").union(spark.range(3).selectExpr("CAST(NULL AS BIGINT)"))
    kept, unknown = gov.revoke_leases(leases, revoked)
    assert sorted(r[0] if r[0] is not None else -1 for r in kept.collect()) == sorted([*(set(range(500)) - {7}), 8, 8, -1])
    assert sorted(r[0] if r[0] is not None else -1 for r in unknown.collect()) == [-1, *range(1000, 1500)]
    assert all(max(len(part) for part in df.rdd.glom().collect()) < 100 for df in (kept, unknown))


def test_a_ticket_ending_now_is_not_valid(spark):
    df = literal_table(spark, [("c", "R", T0), ("d", "R", T0 - dt.timedelta(hours=1))], "client string, realm string, start_time timestamp")
    ticket = gov.current_tickets(gov.issue_tickets(df, 3600))
    assert ticket.count() == 1
    at = lambda s: gov.valid_tickets(ticket, F.lit(T0 + dt.timedelta(seconds=s))).first()
    assert at(3599)["valid"] and not at(3600)["valid"]
    assert at(0)["server"] == "krbtgt/R@R" and at(0)["client"] == "c"
    assert at(0)["renew_till"] - at(0)["start_time"] == dt.timedelta(hours=7)


def test_policies_append(spark, folder):
    for name in ("a", "b"):
        gov.apply_policies(literal_table(spark, [(name, "ClusterPolicy", "{}")], gov.POLICY_SCHEMA), folder)
    assert sorted(r["name"] for r in gov.list_policies(spark, folder).collect()) == ["a", "b"]
