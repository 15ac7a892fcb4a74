import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harborline.operators import crypto
from harborline.session import literal_table, stage

SECRET = b"secret of this job"
KEYS = [("k", i, f"v{i}", bytes([i]) * 32) for i in (1, 2, 9, 10)] + [("other", 1, "v1", b"o" * 32)]


@pytest.fixture(scope="module")
def keys(spark):
    return literal_table(spark, KEYS, "key_name string, version_number bigint, version string, key_bytes binary").withColumn(
        "cipher", F.lit("AES/GCM"))


@pytest.fixture(scope="module")
def zones(spark):
    return literal_table(spark, [("/z", "k"), ("/z/deep", "other")], "zone_path string, key_name string")


@pytest.fixture(scope="module")
def sealed(spark, keys, zones):
    rows = literal_table(spark, [(p, f"text of {p}") for p in ("/z/a", "/z/deep/b", "/zz/c", "/d")], "path string, payload string")
    return stage(crypto.encrypt_rows(rows, zones, keys, SECRET), "sealed")


def texts(df):
    return {r["path"]: bytes(r["payload"]).decode() for r in df.collect()}


def test_latest_is_compared_as_a_number(keys):
    assert {r["key_name"]: r["version"] for r in crypto.latest_keys(keys).collect()} == {"k": "v10", "other": "v1"}


def test_round_trip_and_zone_borders(sealed, keys):
    found = {r["path"]: (r["key_name"], r["key_version"]) for r in sealed.collect()}
    assert found == {"/z/a": ("k", "v10"), "/z/deep/b": ("other", "v1"), "/zz/c": (None, None), "/d": (None, None)}
    stored = {r["path"]: bytes(r["payload"]) for r in sealed.collect()}
    assert stored["/d"] == b"text of /d" and b"text" not in stored["/z/a"]
    assert texts(crypto.decrypt_rows(sealed, keys)) == {p: f"text of {p}" for p in found}


def test_a_changed_byte_is_noticed(sealed, keys):
    tampered = sealed.withColumn("payload", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(b"!")))
    with pytest.raises(PySparkException):
        crypto.decrypt_rows(tampered.where("path = '/z/a'"), keys).collect()


def test_missing_keys_are_errors(sealed, keys, zones, spark):
    with pytest.raises(PySparkException, match="missing key k v10"):
        crypto.decrypt_rows(sealed, keys.where("version <> 'v10'")).collect()
    row = literal_table(spark, [("/z/a", "x")], "path string, payload string")
    with pytest.raises(PySparkException, match="no key for zone"):
        crypto.encrypt_rows(row, zones, keys.where("key_name = 'other'"), SECRET).collect()


def test_rotation_keeps_payloads_readable(spark, sealed, keys):
    old = keys.where("version_number < 10")
    rows = literal_table(spark, [("/z/a", "one"), ("/z/b", "two"), ("/y/c", "three")], "path string, payload string")
    areas = literal_table(spark, [("/z", "k"), ("/y", "k")], "zone_path string, key_name string")
    before = stage(crypto.encrypt_rows(rows, areas, old, SECRET), "before")
    after = stage(crypto.rewrap_zone(before, keys, "/z"), "after")
    assert {r["path"]: (r["key_version"], r["rewrapped"]) for r in after.collect()} == {
        "/z/a": ("v10", True), "/z/b": ("v10", True), "/y/c": ("v9", False)}
    assert {r["path"]: bytes(r["payload"]) for r in after.collect()} == {r["path"]: bytes(r["payload"]) for r in before.collect()}
    assert texts(crypto.decrypt_rows(after.drop("rewrapped"), keys)) == {"/z/a": "one", "/z/b": "two", "/y/c": "three"}
    assert [tuple(r) for r in crypto.rewrap_summary(after, "/z").collect()] == [("/z", "k", "v10", 2)]
    again = crypto.rewrap_zone(after.drop("rewrapped"), keys, "/z")
    assert again.where("rewrapped").isEmpty()


def test_rewrap_keeps_headers_it_cannot_open(spark, keys):
    areas = literal_table(spark, [("/z", "k")], "zone_path string, key_name string")
    rows = literal_table(spark, [("/z/a", "one")], "path string, payload string")
    before = stage(crypto.encrypt_rows(rows, areas, keys.where("version_number < 10"), SECRET), "before-lost")
    after = crypto.rewrap_zone(before, keys.where("version <> 'v9'"), "/z").first()
    assert not after["rewrapped"] and after["key_version"] == "v9" and after["error"] == "missing key k v9"
    assert after["wrapped_key"] == before.first()["wrapped_key"]
    assert texts(crypto.decrypt_rows(before, keys)) == {"/z/a": "one"}


def test_headers_without_key_and_short_keys_are_errors(spark, sealed, keys):
    with pytest.raises(PySparkException, match="no wrapped key for k v10"):
        crypto.decrypt_rows(sealed.withColumn("wrapped_key", F.lit(None).cast("binary")), keys).collect()
    short = spark.range(1).select(crypto.wrap_key(F.lit(b"x" * 32), F.lit(b"y" * 16)))
    with pytest.raises(PySparkException, match="32 bytes, not 16"):
        short.collect()


def test_key_versions_and_rolling(spark, keys):
    wanted = literal_table(spark, [("k", "v9"), ("k", "v3"), ("gone", "v1")], "key_name string, version string")
    found = {(r["key_name"], r["version"]): r["error"] for r in crypto.key_versions(wanted, keys).collect()}
    assert found == {("k", "v9"): None, ("k", "v3"): "version 'v3' of key 'k' not found", ("gone", "v1"): "key 'gone' not found"}
    material = literal_table(spark, [("k", b"n" * 32), ("gone", b"n" * 32)], "key_name string, key_bytes binary")
    rolled, unknown = crypto.roll_keys(keys, material, F.current_timestamp())
    assert [(r["key_name"], r["version"]) for r in rolled.collect()] == [("k", "v5")]
    assert [r[0] for r in unknown.collect()] == ["gone"]


def test_status_and_listings(sealed, keys, zones, spark):
    headers = sealed.where("wrapped_key IS NOT NULL").select("path", *crypto.HEADER)
    status = crypto.encryption_status(sealed.select("path"), headers)
    assert {r["path"]: r["status"] for r in status.collect()} == {
        "/z/a": "encrypted", "/z/deep/b": "encrypted", "/zz/c": "unencrypted", "/d": "unencrypted"}
    assert "key_bytes" not in crypto.list_keys(keys).columns and crypto.list_zones(zones).count() == 2


def test_data_keys_are_whole_and_differ(spark):
    row = literal_table(spark, [("/a",), ("/b",)], "path string").select(
        crypto.data_key(SECRET, F.col("path")).alias("k"))
    a, b = [bytes(r["k"]) for r in row.collect()]
    assert len(a) == len(b) == 32 and a != b
    assert row.select(crypto.valid_key_length(F.col("k")).alias("v")).first()["v"]


def test_data_keys_are_derived_once_per_row(spark):
    """Each derivation hashes twice; header and payload of a row share one."""
    from harborline.plans import QUERIES
    from harborline.plans.registry import Tables
    from harborline.plans import encryption
    from tests.conftest import SF

    t = Tables(spark, SF)
    zones = encryption._document_zones(t)
    sealed = crypto.encrypt_rows(encryption._document_rows(t), zones, encryption._document_keys(zones), encryption.secret(t))
    for df in (sealed, QUERIES["e6_rewrap_zone"](spark, SF)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == 2
        assert encryption.SECRET.hex().upper() not in plan.upper(), "the secret's bytes are not part of the plan"
