"""Request rules, directory search, group access, lease and ticket lifetimes over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[Column, Column]
"""``(violated, message)``"""

# The most cores one request may ask for, and the violation texts.
MAX_CORES = 32
PRIVILEGED_TEXT = "Spark containers cannot run in privileged mode."
ROOT_TEXT = "Spark containers cannot run as root (user 0)."
CORES_TEXT = "Requested CPU cores (%d) exceeds policy limit of 32."


def job_rules() -> list[Rule]:
    """The admission rules, in the order their violations are reported."""
    return [
        (F.col("privileged"), F.lit(PRIVILEGED_TEXT)),
        (F.col("run_as_user") == 0, F.lit(ROOT_TEXT)),
        (F.col("cpu_cores") > MAX_CORES, F.format_string(CORES_TEXT, F.col("cpu_cores"))),
    ]


def validate_requests(requests: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``violations`` and ``allowed`` to each request row; an empty list of rules allows all."""
    checks = [F.when(broken, message) for broken, message in (job_rules() if rules is None else rules)]
    texts = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return requests.withColumn("violations", texts).withColumn(
        "allowed", F.size("violations") == 0
    )


POLICY_SCHEMA = "name string, kind string, spec string"


def apply_policies(policies: DataFrame, path: str) -> None:
    """Append policy documents; ``spec`` is kept as JSON text and not evaluated."""
    policies.select("name", "kind", "spec").write.mode("append").parquet(path)


def list_policies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY_SCHEMA).parquet(path)


def search_users(users: DataFrame, query: str, uid: str = "uid", full_name: str = "full_name") -> DataFrame:
    """Users whose uid holds the text as typed, or whose name holds it in any case."""
    return users.where(
        F.col(uid).contains(query) | F.lower(F.col(full_name)).contains(query.lower())
    )


def group_names(memberships: Column) -> Column:
    """Group names from distinguished names: the first component if it is a ``cn``, else nothing."""
    heads = F.transform(memberships, lambda dn: F.split(dn, ",")[0])
    named = F.filter(heads, lambda head: head.startswith("cn="))
    return F.transform(named, lambda head: F.regexp_replace(head, "^cn=", ""))


def authorize_groups(users: DataFrame, groups: str, allowed: Sequence[str]) -> DataFrame:
    """Add ``authorized``: any of the user's groups is on the allowed list.  Unknown groups are none."""
    overlap = F.arrays_overlap(F.col(groups), F.array(*[F.lit(g) for g in allowed]).cast("array<string>"))
    return users.withColumn("authorized", F.coalesce(overlap, F.lit(False)))


def judge_requests(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Every request with its role's columns, the lease it would get, and ``reason`` where it is refused.

    ``requests``: ``lease_id, role, requested_ttl, issue_time``; ``roles``: ``role_name, db_name,
    default_ttl_secs, max_ttl_secs``.  A requested lifetime must be positive.
    """
    matched = requests.join(roles, F.col("role") == F.col("role_name"), "left")
    reason = F.when(
        F.col("role_name").isNull(),
        F.concat(F.lit("role '"), F.coalesce("role", F.lit("")), F.lit("' not configured")),
    ).when(F.col("requested_ttl") <= 0, F.lit("requested lifetime must be positive"))
    ttl = F.least(F.coalesce("requested_ttl", "default_ttl_secs"), F.col("max_ttl_secs"))
    return matched.withColumn("reason", reason).withColumn("ttl_secs", ttl).withColumn(
        "expire_time", F.when(F.col("reason").isNull(), F.timestamp_add("SECOND", F.col("ttl_secs"), F.col("issue_time")))
    )


def issue_leases(requests: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leases for valid requests, and the rejected requests with a reason."""
    judged = judge_requests(requests, roles)
    leases = judged.where(F.col("reason").isNull()).select("lease_id", "role", "db_name", "issue_time", "expire_time", "ttl_secs")
    return leases, judged.where(F.col("reason").isNotNull()).select("lease_id", "role", "reason")


#: Leases or revocations that one task compares; ids compress so well that Spark's sizes would put far more into one.
TASK_ROWS = 1 << 20


def revoke_leases(leases: DataFrame, revocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leases that stay, and revocations that name no lease.

    Both tables are dealt by id to as many tasks as their rows ask for.
    """
    tasks = -(-max(leases.count(), revocations.count()) // TASK_ROWS)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "lease_id") if tasks > 1 else rows

    named = dealt(revocations.select("lease_id")).distinct()
    held = dealt(leases)
    return held.join(named, "lease_id", "left_anti"), named.join(held.select("lease_id"), "lease_id", "left_anti")


def expire_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Leases whose time is up; a lease ending exactly ``now`` is up."""
    return leases.where(F.col("expire_time") <= now)


def active_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Leases still running, with the whole seconds they have left."""
    left = F.timestamp_diff("SECOND", now, F.col("expire_time"))
    return leases.where(F.col("expire_time") > now).withColumn(
        "remaining_secs", F.greatest(F.lit(0).cast("bigint"), left)
    )


def role_users(leases: DataFrame, now: Column) -> DataFrame:
    """Database users of the running leases with their privileges."""
    return active_leases(leases, now).select(
        F.concat(
            F.lit("v-token-"), F.replace("role", F.lit("-"), F.lit("_")), F.lit("-"),
            F.col("lease_id").cast("string"),
        ).alias("username"),
        F.array(
            F.concat(F.lit("CONNECT ON "), F.col("db_name")), F.lit("SELECT ON ALL TABLES")
        ).alias("privileges"),
        F.col("expire_time").alias("valid_until"),
    )


# Fixed value: a ticket can be renewed for this many lifetimes.
RENEWAL_LIFETIMES = 7


def issue_tickets(requests: DataFrame, lifetime_secs: int) -> DataFrame:
    """Ticket validity from ``client, realm, start_time``."""
    return requests.select(
        "client", "realm",
        F.concat(F.lit("krbtgt/"), "realm", F.lit("@"), "realm").alias("server"),
        "start_time",
        F.timestamp_add("SECOND", F.lit(lifetime_secs), F.col("start_time")).alias("end_time"),
        F.timestamp_add("SECOND", F.lit(lifetime_secs * RENEWAL_LIFETIMES), F.col("start_time")).alias("renew_till"),
    )


def current_tickets(tickets: DataFrame) -> DataFrame:
    """The latest ticket per server; a new ticket replaces the one before it."""
    columns = [c for c in tickets.columns if c != "server"]
    return (
        tickets.groupBy("server")
        .agg(F.max_by(F.struct(*columns), F.struct("start_time", "client")).alias("t"))
        .select("server", "t.*")
    )


def valid_tickets(tickets: DataFrame, now: Column) -> DataFrame:
    """Add ``valid``; a ticket ending exactly ``now`` is not valid."""
    return tickets.withColumn("valid", F.col("end_time") > now)
