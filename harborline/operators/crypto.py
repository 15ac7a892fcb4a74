"""Envelope encryption of rows, key versions and bulk rewrapping of data keys.

Master keys and the job secret are inputs; no key is made up in a query.  Payloads and wrapped data
keys use AES-GCM, each with its own random IV carried in the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.joins import longest_prefix_join
from harborline.sources.files import under_prefix

HEADER = ("key_name", "key_version", "wrapped_key")


def assign_zone(paths: DataFrame, zones: DataFrame, path: str = "path") -> DataFrame:
    """Most specific zone (``zone_path``, ``key_name``) covering each path; nulls outside zones."""
    return longest_prefix_join(paths, path, zones, "zone_path", ["key_name"])


def data_key(secret: bytes | Column, path: Column) -> Column:
    """32-byte data key of one path, derived from the job's secret.

    Derived rather than random, so that a task retried after an executor loss arrives at the same
    key for the payload and for its header.  The path is hashed between two uses of the secret, as in
    an HMAC.  Pass the secret as a column, for instance of a keys table: a literal is part of plans
    and event logs.
    """
    key = secret if isinstance(secret, Column) else F.lit(secret)
    inner = F.unhex(F.sha2(F.concat(key, F.encode(path, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(key, inner), 256))


def valid_key_length(key: Column) -> Column:
    return F.octet_length(key) == 32


def checked_key(master: Column) -> Column:
    """``master``, or an error if it is not 32 bytes long; null stays null."""
    return F.when(master.isNull() | valid_key_length(master), master).otherwise(
        F.raise_error(F.concat(F.lit("a master key has 32 bytes, not "), F.octet_length(master).cast("string"))).cast("binary")
    )


def wrap_key(plain_key: Column, master: Column) -> Column:
    return F.aes_encrypt(plain_key, checked_key(master), F.lit("GCM"))


def unwrap_key(wrapped: Column, master: Column) -> Column:
    return F.aes_decrypt(wrapped, checked_key(master), F.lit("GCM"))


def latest_keys(keys: DataFrame) -> DataFrame:
    """Newest version per key name, compared as a number (``v10`` is newer than ``v9``)."""
    rest = [c for c in keys.columns if c != "key_name"]
    return (
        keys.groupBy("key_name")
        .agg(F.max_by(F.struct(*rest), F.col("version_number")).alias("k"))
        .select("key_name", "k.*")
    )


def key_versions(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested ``(key_name, version)`` pairs with the key, or with the reason it is missing."""
    names = keys.select(F.col("key_name").alias("__name")).distinct()
    found = requests.join(keys, ["key_name", "version"], "left").join(
        names, F.col("key_name") == F.col("__name"), "left"
    )
    reason = F.when(F.col("__name").isNull(), F.concat(F.lit("key '"), "key_name", F.lit("' not found"))).when(
        F.col("version_number").isNull(),
        F.concat(F.lit("version '"), "version", F.lit("' of key '"), "key_name", F.lit("' not found")),
    )
    return found.withColumn("error", reason).drop("__name")


def roll_keys(keys: DataFrame, material: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """The next version of each key in ``material`` (``key_name, key_bytes``), and unknown names.

    The version number is one more than the versions the key has.
    """
    counts = keys.groupBy("key_name").agg(F.count(F.lit(1)).alias("__n"), F.max("cipher").alias("cipher"))
    rolled = material.join(counts, "key_name").select(
        "key_name",
        (F.col("__n") + 1).alias("version_number"),
        F.concat(F.lit("v"), (F.col("__n") + 1).cast("string")).alias("version"),
        "cipher",
        created_at.alias("created_at"),
        "key_bytes",
    )
    return rolled, material.join(counts, "key_name", "left_anti").select("key_name")


def encrypt_rows(
    rows: DataFrame, zones: DataFrame, keys: DataFrame, secret: bytes | Column,
    path: str = "path", payload: str = "payload",
) -> DataFrame:
    """Encrypt ``payload`` of the rows whose path lies in a zone, under the zone's latest key.

    Header columns are null, and the payload unchanged, outside the zones.  Header and ciphertext
    leave in the same row, so write both in one go.
    """
    masters = latest_keys(keys).select(
        "key_name", F.col("version").alias("key_version"), F.col("key_bytes").alias("__master")
    )
    zoned = assign_zone(rows, zones, path).join(masters, "key_name", "left")
    guarded = zoned.withColumn(
        "__master",
        F.when(
            F.col("zone_path").isNotNull() & F.col("__master").isNull(),
            F.raise_error(F.concat(F.lit("no key for zone "), F.col("zone_path"))),
        ).otherwise(F.col("__master")),
    )
    plain = F.col(payload).cast("binary")
    inside = F.col("__master").isNotNull()
    # A column of its own, so that the key is derived once for payload and header.
    derived = guarded.withColumn("__fresh", F.when(inside, data_key(secret, F.col(path))))
    return derived.select(
        *[c for c in rows.columns if c != payload],
        F.when(inside, F.aes_encrypt(plain, F.col("__fresh"), F.lit("GCM"))).otherwise(plain).alias(payload),
        "key_name", "key_version",
        F.when(inside, wrap_key(F.col("__fresh"), F.col("__master"))).alias("wrapped_key"),
    )


def decrypt_rows(rows: DataFrame, keys: DataFrame, payload: str = "payload") -> DataFrame:
    """Undo :func:`encrypt_rows` with the master version each header names.

    A header that names a key but holds no wrapped key is an error, not plain text.
    """
    masters = keys.select(
        "key_name", F.col("version").alias("key_version"), F.col("key_bytes").alias("__master")
    )
    opened = rows.join(masters, ["key_name", "key_version"], "left")
    sealed = F.col("wrapped_key").isNotNull()
    lost = F.col("key_name").isNotNull() & ~sealed
    missing = sealed & F.col("__master").isNull()
    plain = F.when(
        missing, F.raise_error(F.concat_ws(" ", F.lit("missing key"), "key_name", "key_version")).cast("binary")
    ).when(
        lost, F.raise_error(F.concat_ws(" ", F.lit("no wrapped key for"), "key_name", "key_version")).cast("binary")
    ).when(
        sealed,
        F.aes_decrypt(F.col(payload), unwrap_key(F.col("wrapped_key"), F.col("__master")), F.lit("GCM")),
    ).otherwise(F.col(payload))
    return opened.select(
        *[c for c in rows.columns if c not in (payload, *HEADER)], plain.alias(payload)
    )


def rewrap_zone(headers: DataFrame, keys: DataFrame, zone: str, path: str = "path") -> DataFrame:
    """All headers, those below ``zone`` on an old key version moved to the latest; adds ``rewrapped``.

    Only the wrapped data key changes; payloads stay as they are.  A header whose old version is not
    among the keys cannot be opened: it stays as it is, and ``error`` says why.
    """
    old = keys.select(
        "key_name", F.col("version").alias("key_version"), F.col("key_bytes").alias("__old")
    )
    new = latest_keys(keys).select(
        "key_name", F.col("version").alias("__version"), F.col("key_bytes").alias("__new")
    )
    joined = headers.join(old, ["key_name", "key_version"], "left").join(new, "key_name", "left")
    stale = F.coalesce(under_prefix(F.col(path), zone) & (F.col("key_version") != F.col("__version")), F.lit(False))
    due = stale & F.col("__old").isNotNull() & F.col("wrapped_key").isNotNull()
    error = F.when(
        stale & ~due, F.concat_ws(" ", F.lit("missing key"), F.col("key_name"), F.col("key_version"))
    )
    return joined.select(
        *[c for c in headers.columns if c not in (*HEADER, "rewrapped", "error")],
        "key_name",
        F.when(due, F.col("__version")).otherwise(F.col("key_version")).alias("key_version"),
        F.when(due, wrap_key(unwrap_key(F.col("wrapped_key"), F.col("__old")), F.col("__new")))
        .otherwise(F.col("wrapped_key")).alias("wrapped_key"),
        due.alias("rewrapped"),
        error.alias("error"),
    )


def rewrap_summary(rewrapped: DataFrame, zone: str) -> DataFrame:
    """Rewrapped headers per key and version; the paths themselves stay in the long table."""
    return (
        rewrapped.where("rewrapped")
        .groupBy("key_name", F.col("key_version").alias("target_version"))
        .agg(F.count(F.lit(1)).alias("rewrapped_count"))
        .select(F.lit(zone).alias("zone_path"), "key_name", "target_version", "rewrapped_count")
    )


def encryption_status(files: DataFrame, headers: DataFrame, path: str = "path") -> DataFrame:
    known = headers.select(path, *HEADER)
    return files.join(known, path, "left").withColumn(
        "status", F.when(F.col("wrapped_key").isNotNull(), "encrypted").otherwise("unencrypted")
    )


def list_zones(zones: DataFrame) -> DataFrame:
    return zones.select("zone_path", "key_name")


def list_keys(keys: DataFrame) -> DataFrame:
    """All key versions without the key bytes."""
    return keys.drop("key_bytes")
