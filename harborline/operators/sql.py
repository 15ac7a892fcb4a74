"""SQL text in, lazy DataFrame out, plus a log of finished queries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_DESCRIBING = ("EXPLAIN", "DESCRIBE", "DESC", "SHOW")


class SqlCompilationError(ValueError):
    """The text does not parse, does not resolve, or is not a read-only query."""


class SqlExecutionError(RuntimeError):
    """The query was valid but failed while running."""


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """One read-only query.  Statements with side effects do not resolve as a subquery and fail."""
    query = text.strip().rstrip(";")
    words = query.split(None, 1)
    try:
        if words and words[0].upper() in _DESCRIBING:
            return spark.sql(query, args=dict(args or {}))
        spark.sql(f"SELECT * FROM (\n{query}\n)", args=dict(args or {}))
        return spark.sql(query, args=dict(args or {}))
    except (ParseException, AnalysisException) as err:
        raise SqlCompilationError(f"SQL compilation error: {err}") from err


LOG_SCHEMA = (
    "query_id string, finished_at timestamp, query string, status string, "
    "duration_secs double, row_count bigint, error string"
)


def run_sql_to(
    spark: SparkSession, text: str, result_path: str, log_path: str,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Run a query into a Parquet folder and append one row on it to the query log.

    Rows are counted while they are written.  Duration is logged for failures too, but only
    successes enter the duration histogram (see :func:`query_log_metrics`).
    """
    started, counted = time.monotonic(), Observation()
    status, rows, error = "success", None, None
    try:
        result = run_sql(spark, text, args)
        result.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(result_path)
        rows = counted.get["rows"]
    except SqlCompilationError as err:
        status, error = "error", str(err)
        raise
    except PySparkException as err:
        status, error = "error", f"Execution error: {err}"
        raise SqlExecutionError(error) from err
    finally:
        entry = (uuid.uuid4().hex, text, status, time.monotonic() - started, rows, error)
        (
            spark.createDataFrame(
                [entry],
                "query_id string, query string, status string, duration_secs double, "
                "row_count bigint, error string",
            )
            .withColumn("finished_at", F.current_timestamp())
            .select("query_id", "finished_at", "query", "status", "duration_secs", "row_count", "error")
            .write.mode("append").parquet(log_path)
        )
    return spark.read.schema(result.schema).parquet(result_path)


def service_stats(events: DataFrame, service: str, measure: str) -> DataFrame:
    """Events and average measure per service, busiest first."""
    return (
        events.groupBy(F.col(service).alias("service_name"))
        .agg(F.count(F.lit(1)).alias("events"), F.avg(measure).alias("avg_cpu"))
        .orderBy(F.col("avg_cpu").desc(), "service_name")
    )


def query_log_metrics(log: DataFrame) -> DataFrame:
    """Queries per status; observed durations and rows of the successful ones."""
    succeeded = F.col("status") == "success"
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("queries_total"),
        F.count(F.when(succeeded, F.col("duration_secs"))).alias("observed"),
        F.coalesce(F.sum(F.when(succeeded, F.col("duration_secs"))), F.lit(0.0)).alias("duration_sum"),
        F.coalesce(F.sum(F.when(succeeded, F.col("row_count"))), F.lit(0)).alias("rows_total"),
    )
