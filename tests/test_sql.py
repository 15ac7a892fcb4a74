import pytest
from pyspark.sql import functions as F

from harborline.operators.sql import (
    SqlCompilationError,
    SqlExecutionError,
    query_log_metrics,
    run_sql,
    run_sql_to,
    service_stats,
)
from harborline.session import literal_table

# Eight events of seven services with their expected statistics.
EVENTS = [
    (1001, "spark-driver", 74.5), (1002, "hdfs-datanode", 12.2), (1003, "iceberg-catalog", 5.4), (1004, "vault-agent", 2.1),
    (1005, "spark-executor-1", 88.9), (1006, "spark-executor-2", 93.4), (1007, "freeipa-kdc", 1.8), (1008, "spark-driver", 62.0),
]
EXPECTED = [
    ("spark-executor-2", 1, 93.4), ("spark-executor-1", 1, 88.9), ("spark-driver", 2, 68.25), ("hdfs-datanode", 1, 12.2),
    ("iceberg-catalog", 1, 5.4), ("vault-agent", 1, 2.1), ("freeipa-kdc", 1, 1.8),
]


def cluster_events(spark):
    return literal_table(spark, EVENTS, "event_id bigint, service_name string, cpu_usage double")


def test_service_stats_golden(spark):
    assert [tuple(r) for r in service_stats(cluster_events(spark), "service_name", "cpu_usage").collect()] == EXPECTED


def test_sql_text_golden(spark):
    cluster_events(spark).createOrReplaceTempView("cluster_events")
    found = run_sql(spark, """SELECT service_name, COUNT(*) AS events, AVG(cpu_usage) AS avg_cpu FROM cluster_events
                              GROUP BY service_name ORDER BY avg_cpu DESC;""")
    assert [tuple(r) for r in found.collect()] == EXPECTED


def test_arguments(spark):
    assert run_sql(spark, "SELECT :a + 1 AS b -- note", {"a": 4}).first()[0] == 5


@pytest.mark.parametrize("text", ["SELEC 1", "SELECT missing FROM range(3)", "SELECT * FROM no_such_table", ""])
def test_compilation_errors(spark, text):
    with pytest.raises(SqlCompilationError, match="^SQL compilation error"):
        run_sql(spark, text)


@pytest.mark.parametrize("text", [
    "CREATE TABLE t (a INT)", "DROP VIEW IF EXISTS cluster_events", "INSERT INTO t VALUES (1)", "SET a = b",
    "CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "CACHE TABLE t",
])
def test_only_queries_run(spark, text):
    with pytest.raises(SqlCompilationError):
        run_sql(spark, text)


@pytest.mark.parametrize("text", ["EXPLAIN SELECT 1", "DESCRIBE QUERY SELECT 1 AS a", "SHOW FUNCTIONS", "VALUES (1), (2)",
                                  "WITH a AS (SELECT 1 AS x) SELECT * FROM a ORDER BY x"])
def test_describing_and_queries_run(spark, text):
    assert run_sql(spark, text).count() >= 1


def test_log_of_good_and_bad_queries(spark, folder):
    out = run_sql_to(spark, "SELECT id FROM range(7)", f"{folder}/a", f"{folder}/log")
    assert out.count() == 7
    with pytest.raises(SqlCompilationError):
        run_sql_to(spark, "SELECT nope", f"{folder}/b", f"{folder}/log")
    with pytest.raises(SqlExecutionError, match="^Execution error"):
        run_sql_to(spark, "SELECT CAST(CONCAT('x', id) AS INT) AS n FROM range(3)", f"{folder}/c", f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    found = {r["status"]: r for r in query_log_metrics(log).collect()}
    assert (found["success"]["queries_total"], found["success"]["observed"], found["success"]["rows_total"]) == (1, 1, 7)
    assert (found["error"]["queries_total"], found["error"]["observed"], found["error"]["rows_total"]) == (2, 0, 0)
    assert found["success"]["duration_sum"] > 0
    assert log.where(F.col("error").startswith("Execution error")).count() == 1


def test_empty_result_keeps_schema(spark, folder):
    assert run_sql_to(spark, "SELECT 1 AS a WHERE false", f"{folder}/e", f"{folder}/log").columns == ["a"]
