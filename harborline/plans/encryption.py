"""Zones, key versions, envelope encryption and rewrapping over mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.operators import crypto
from harborline.plans.registry import Tables, query
from harborline.session import literal_table, spread, stage

SECRET = b"a job secret given by the caller"


def secret(t: Tables):
    """The job's secret from a stored table of one row, so that plans hold a reference to it and not its bytes."""
    return stage(literal_table(t.spark, [(SECRET,)], "secret binary"), "secret").scalar()


def order_keys(t: Tables):
    """One key per order priority, one version per year in which it was used; a stored table."""
    keys = (
        t.orders.select(
            F.col("o_orderpriority").alias("key_name"), (F.year("o_orderdate") - 1994).cast("bigint").alias("version_number")
        )
        .distinct()
        .select(
            "key_name", "version_number", F.concat(F.lit("v"), F.col("version_number").cast("string")).alias("version"),
            F.lit("AES/GCM").alias("cipher"),
            F.unhex(F.sha2(F.concat_ws("#", "key_name", F.col("version_number").cast("string")), 256)).alias("key_bytes"),
        )
    )
    return stage(keys, "keys")


KEYS_SQL = "SELECT DISTINCT o_orderpriority AS key_name, CAST(year(o_orderdate) - 1994 AS BIGINT) AS version_number FROM orders"


def order_headers(t: Tables, keys):
    """A header per order: its data key wrapped under the version of the order's year, and the plain key to compare with.

    An order without date or priority has no key, and so no header.
    """
    placed = spread(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")).where("o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL").select(
        F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderpriority").alias("key_name"),
        F.concat(F.lit("v"), (F.year("o_orderdate") - 1994).cast("string")).alias("key_version"),
    )
    masters = keys.select("key_name", F.col("version").alias("key_version"), "key_bytes")
    keyed = placed.join(masters, ["key_name", "key_version"])
    return keyed.withColumn("plain_key", crypto.data_key(secret(t), F.col("path"))).select(
        "path", "key_name", "key_version", "plain_key", crypto.wrap_key(F.col("plain_key"), F.col("key_bytes")).alias("wrapped_key")
    )


_ZONES_SQL = """
SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') AS zone_path, 'host' AS key_name FROM pages
UNION
SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/[^/?#]+'), 'section' FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/[^/?#]+')
"""


def page_zones(t: Tables):
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    section = F.regexp_extract("url", "^[a-z]+://[^/]+/[^/?#]+", 0)
    return (
        t.pages.select(host.alias("zone_path"), F.lit("host").alias("key_name"))
        .union(t.pages.select(section, F.lit("section")).where(section != ""))
        .distinct()
    )


@query(
    "e1_assign_zone",
    f"""
    SELECT page_id, url, arg_max(zone_path, length(zone_path)) AS zone_path, arg_max(key_name, length(zone_path)) AS key_name
    FROM pages LEFT JOIN ({_ZONES_SQL}) ON url = zone_path OR starts_with(url, zone_path || '/') GROUP BY page_id, url
    """,
)
def e1_assign_zone(t: Tables):
    return crypto.assign_zone(t.pages.select("page_id", "url"), page_zones(t), "url")


def _document_rows(t: Tables):
    return spread(t.documents.select("doc_id", "lang", "source", "text")).select(
        "doc_id", F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("payload"),
    )


def _document_zones(t: Tables):
    """English as one zone and each French source as its own; other languages lie outside."""
    lang = t.documents.select("lang", "source").distinct()
    english = lang.where("lang = 'en'").select(F.lit("/en").alias("zone_path"), F.lit("english").alias("key_name"))
    french = lang.where("lang = 'fr'").select(
        F.concat(F.lit("/fr/"), "source").alias("zone_path"), F.concat(F.lit("french-"), "source").alias("key_name")
    )
    return stage(english.union(french).distinct(), "zones")


def _document_keys(zones):
    names = zones.select("key_name").distinct()
    keys = names.select(
        "key_name", F.explode(F.expr("array(9L, 10L)")).alias("version_number")
    ).select(
        "key_name", "version_number", F.concat(F.lit("v"), F.col("version_number").cast("string")).alias("version"),
        F.unhex(F.sha2(F.concat_ws("#", "key_name", F.col("version_number").cast("string")), 256)).alias("key_bytes"),
    )
    return stage(keys, "keys")


@query(
    "e2_encrypt_and_decrypt_rows",
    """
    SELECT doc_id, md5(text) AS digest, coalesce(lang IN ('en', 'fr'), false) AS was_encrypted,
           CASE WHEN lang IN ('en', 'fr') THEN 'v10' END AS key_version
    FROM documents
    """,
)
def e2_encrypt_and_decrypt_rows(t: Tables):
    """Texts are encrypted, written, read back and decrypted; stored bytes differ from the text."""
    zones = _document_zones(t)
    keys = _document_keys(zones)
    sealed = stage(
        crypto.encrypt_rows(_document_rows(t), zones, keys, secret(t))
        .withColumn("sealed_digest", F.md5("payload")).withColumn("version_used", F.col("key_version")),
        "sealed",
    )
    return crypto.decrypt_rows(sealed, keys).select(
        "doc_id", F.md5("payload").alias("digest"),
        (F.md5("payload") != F.col("sealed_digest")).alias("was_encrypted"), F.col("version_used").alias("key_version"),
    )


@query(
    "e3_wrap_and_unwrap_keys",
    """
    SELECT o_orderkey, 'v' || (year(o_orderdate) - 1994) AS key_version, true AS opens, CAST(32 AS BIGINT) AS key_length FROM orders
    WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL
    """,
)
def e3_wrap_and_unwrap_keys(t: Tables):
    keys = order_keys(t)
    masters = keys.select("key_name", F.col("version").alias("key_version"), "key_bytes")
    opened = order_headers(t, keys).join(masters, ["key_name", "key_version"]).withColumn(
        "plain", crypto.unwrap_key(F.col("wrapped_key"), F.col("key_bytes"))
    )
    return opened.select(
        F.substring_index("path", "/", -1).cast("bigint").alias("o_orderkey"), "key_version",
        (F.col("plain") == F.col("plain_key")).alias("opens"),
        F.octet_length("plain").cast("bigint").alias("key_length"),
    )


@query(
    "e4_roll_key",
    f"""
    SELECT key_name, count(*) + 1 AS version_number, 'v' || (count(*) + 1) AS version FROM ({KEYS_SQL}) GROUP BY key_name
    """,
)
def e4_roll_key(t: Tables):
    return rolled_keys(t, order_keys(t), F.expr("TIMESTAMP_NTZ '2024-01-31'")).select("key_name", "version_number", "version")


def rolled_keys(t: Tables, keys, time):
    material = t.orders.select(F.col("o_orderpriority").alias("key_name")).distinct().withColumn(
        "key_bytes", F.unhex(F.sha2(F.concat(F.lit("next"), "key_name"), 256))
    )
    return crypto.roll_keys(keys, material, time)[0]


@query(
    "e5_latest_key",
    f"SELECT key_name, max(version_number) AS version_number, 'v' || max(version_number) AS version FROM ({KEYS_SQL}) GROUP BY key_name",
)
def e5_latest_key(t: Tables):
    return crypto.latest_keys(order_keys(t)).select("key_name", "version_number", "version")


@query(
    "e5_key_version",
    f"""
    SELECT key_name, version, version_number,
           CASE WHEN key_name = 'none' THEN 'key ''none'' not found'
                WHEN version_number IS NULL THEN 'version ''' || version || ''' of key ''' || key_name || ''' not found' END AS error
    FROM (SELECT DISTINCT CASE WHEN o_custkey % 50 = 0 THEN 'none' ELSE o_orderpriority END AS key_name, 'v' || (o_custkey % 10) AS version FROM orders)
    LEFT JOIN (SELECT key_name, version_number, 'v' || version_number AS version FROM ({KEYS_SQL})) USING (key_name, version)
    """,
)
def e5_key_version(t: Tables):
    requests = t.orders.select(
        F.when(F.col("o_custkey") % 50 == 0, "none").otherwise(F.col("o_orderpriority")).alias("key_name"),
        F.concat(F.lit("v"), (F.col("o_custkey") % 10).cast("string")).alias("version"),
    ).distinct()
    return crypto.key_versions(requests, order_keys(t)).select("key_name", "version", "version_number", "error")


ZONE = "/2-HIGH"
REWRAPPED_SQL = """
SELECT '/' || o_orderpriority || '/' || o_orderkey AS path, o_orderpriority AS key_name,
       o_orderpriority = '2-HIGH' AND year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders WHERE o_orderpriority = '2-HIGH') AS rewrapped,
       year(o_orderdate) - 1994 AS v, (SELECT max(year(o_orderdate)) - 1994 FROM orders WHERE o_orderpriority = '2-HIGH') AS latest
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL
"""


@query(
    "e6_rewrap_zone",
    f"""
    SELECT path, 'v' || CASE WHEN rewrapped THEN latest ELSE v END AS key_version, rewrapped, true AS opens FROM ({REWRAPPED_SQL})
    """,
)
def e6_rewrap_zone(t: Tables):
    keys = order_keys(t)
    masters = keys.select("key_name", F.col("version").alias("key_version"), "key_bytes")
    moved = crypto.rewrap_zone(order_headers(t, keys), keys, ZONE)
    return moved.join(masters, ["key_name", "key_version"]).select(
        "path", "key_version", "rewrapped",
        (crypto.unwrap_key(F.col("wrapped_key"), F.col("key_bytes")) == F.col("plain_key")).alias("opens"),
    )


@query(
    "e7_rewrap_summary",
    f"""
    SELECT '{ZONE}' AS zone_path, key_name, 'v' || latest AS target_version, count(*) AS rewrapped_count
    FROM ({REWRAPPED_SQL}) WHERE rewrapped GROUP BY key_name, latest
    """,
)
def e7_rewrap_summary(t: Tables):
    return rewraps(t, order_keys(t))


def rewraps(t: Tables, keys):
    return crypto.rewrap_summary(crypto.rewrap_zone(order_headers(t, keys), keys, ZONE), ZONE)


@query(
    "e8_encryption_status",
    """
    SELECT o_orderkey AS path, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'encrypted' ELSE 'unencrypted' END AS status
    FROM orders
    """,
)
def e8_encryption_status(t: Tables):
    headers = t.lineitem.select(F.col("l_orderkey").alias("path")).distinct().select(
        "path", F.lit("k").alias("key_name"), F.lit("v1").alias("key_version"), F.lit(b"x").alias("wrapped_key")
    )
    return crypto.encryption_status(t.orders.select(F.col("o_orderkey").alias("path")), headers).select("path", "status")


@query("e9_list_zones", f"SELECT zone_path, key_name FROM ({_ZONES_SQL})")
def e9_list_zones(t: Tables):
    return crypto.list_zones(page_zones(t))


@query(
    "e9_list_keys",
    f"SELECT key_name, version_number, 'v' || version_number AS version, 'AES/GCM' AS cipher FROM ({KEYS_SQL})",
)
def e9_list_keys(t: Tables):
    return crypto.list_keys(order_keys(t))


@query(
    "e6_rewrap_with_a_lost_version",
    f"""
    SELECT path, 'v' || CASE WHEN rewrapped AND v > 1 THEN latest ELSE v END AS key_version, rewrapped AND v > 1 AS rewrapped,
           CASE WHEN rewrapped AND v = 1 THEN 'missing key ' || key_name || ' v1' END AS error
    FROM ({REWRAPPED_SQL})
    """,
)
def e6_rewrap_with_a_lost_version(t: Tables):
    """Headers under a version that is gone stay as they are, with the reason."""
    keys = order_keys(t)
    moved = crypto.rewrap_zone(order_headers(t, keys), keys.where("version_number > 1"), ZONE)
    return moved.select("path", "key_version", "rewrapped", "error")
