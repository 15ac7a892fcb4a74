import os

import pytest

from harborline import session


def test_staged_rows_and_cleanup(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "_staged", {})
    monkeypatch.setattr(session, "new_folder", lambda s, label: f"{folder}/{label}")
    staged = session.stage(spark.range(5), "five")
    assert staged.count() == 5 and os.path.exists(f"{folder}/five")
    assert session.clear_staged(spark) == 1 and not os.path.exists(f"{folder}/five")
    assert session.clear_staged(spark) == 0


def test_unstage_deletes_only_what_it_is_given(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "_staged", {})
    monkeypatch.setattr(session, "new_folder", lambda s, label: f"{folder}/{label}")
    done, other = session.stage(spark.range(5), "done"), session.stage(spark.range(3), "other")
    session.unstage(spark, done)
    assert not os.path.exists(f"{folder}/done") and other.count() == 3
    assert session.clear_staged(spark) == 1


def test_folders_of_streams_and_jobs_are_cleared_too(spark):
    session.clear_staged(spark)
    path = session.new_folder(spark, "job")
    spark.range(3).write.parquet(f"{path}/data")
    assert session.clear_staged(spark) == 1 and not os.path.exists(path)


def test_literal_tables_have_a_known_size(spark):
    df = session.literal_table(spark, [(1, None)], "a bigint, b map<string,string>")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(1, None)]


def test_a_cluster_needs_the_shared_folder_setting(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
