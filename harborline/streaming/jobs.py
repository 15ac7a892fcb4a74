"""Continuous versions of the series, counter and lease operators on Structured Streaming.

Per-key state is Spark's own: lists, values and event-time timers of ``transformWithState`` on the
RocksDB store, kept and restored with the query's checkpoint.  What is held now is read from the
checkpoint by Spark's state reader.  Rows come to the handlers one key at a time and are not
gathered; a key whose state may be large is salted, and the batch operator cuts across the salts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from harborline.operators import governance, metrics, series

#: Groups that the points of one key, or the leases of one stretch of time, are dealt to by their hash, so that a hot key has several state tasks.
SALTS = 16

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _start_stateful(writer, spark: SparkSession, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Start with the RocksDB store, which a query takes from the session when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return _start(writer, checkpoint, available_now)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable as the last finished batch left it."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _time(column: str, kind: str):
    return F.timestamp_micros(column).cast(kind)


def stream_append_points(
    points: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append the points of a stream to a Parquet folder, each exactly once."""
    writer = points.select("key", "value", "ts", "id").writeStream.format("parquet").option("path", path)
    return _start(writer.outputMode("append"), checkpoint, available_now)


class NewestPoints(StatefulProcessor):
    """The newest ``n`` points of a key and salt, as list state; the rest are forgotten."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "value double, ts long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.points.get() if self.points.exists() else ()
        new = ((r["value"], r["ts"], r["id"]) for r in rows)
        newest = heapq.nlargest(self.n, chain(map(tuple, held), new), key=_place)
        self.points.put(newest)
        return iter(())

    def close(self) -> None:
        pass


def _place(point: tuple) -> tuple:
    """Order by time and id, nulls lowest."""
    return point[1] is not None, point[1] or 0, point[2] is not None, point[2] or 0


def stream_retain_last_n(
    points: DataFrame, checkpoint: str, n: int = series.RETAINED_POINTS, available_now: bool = True
) -> StreamingQuery:
    """Keep the newest ``n`` points per key in the query's state; :func:`retained_points` reads them.

    State is at most ``n`` points for each key and salt, however many arrive.
    """
    salted = points.select("key", "value", _micros("ts").alias("ts"), "id", F.pmod(F.xxhash64("ts", "id", "value"), F.lit(SALTS)).alias("salt"))
    kept = salted.groupBy("key", "salt").transformWithState(NewestPoints(n), "key string", "Append", "None")
    return _start_stateful(kept.writeStream.format("noop").outputMode("append"), points.sparkSession, checkpoint, available_now)


def retained_points(spark: SparkSession, checkpoint: str, n: int = series.RETAINED_POINTS) -> DataFrame:
    """The newest ``n`` points per key that :func:`stream_retain_last_n` holds now: its salts cut together."""
    held = _state(spark, checkpoint, "points")
    points = held.select("key.key", "list_element.value", _time("list_element.ts", "timestamp_ntz").alias("ts"), "list_element.id")
    return series.retain_last_n(points, n)


def stream_counters_histogram(
    events: DataFrame, path: str, checkpoint: str, label: str, value: str,
    bounds: Sequence[float] = metrics.DURATION_BOUNDS, available_now: bool = True,
) -> StreamingQuery:
    """Count observations per label and bucket; a batch writes only the counts it changed.

    ``<path>/batch_id=<n>`` holds the new counts of batch n, and a batch that runs again replaces its
    own.  :func:`current_histogram` reads them.
    """

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    counts = metrics.bucket_counts(events, label, value, bounds)
    return _start(counts.writeStream.outputMode("update").foreachBatch(publish), checkpoint, available_now)


def current_histogram(spark: SparkSession, path: str, bounds: Sequence[float] = metrics.DURATION_BOUNDS) -> DataFrame:
    """Cumulative histogram per label from the latest count of every label and bucket."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException as err:
        raise LookupError(f"no finished batch below {path}") from err
    latest = written.groupBy("label", "bucket").agg(F.max_by(F.struct("n", "s"), "batch_id").alias("c"))
    return metrics.cumulate_buckets(latest.select("label", "bucket", "c.n", "c.s"), bounds)


LEASE_FIELDS = ("lease_id", "role", "db_name", "ttl_secs", "issued", "ends")
#: Leases that end within so many microseconds of each other share a key of the state, with ``SALTS`` keys for each stretch of time.
STRETCH = 600_000_000
_APPENDED = 10_000


class LeaseTimers(StatefulProcessor):
    """Leases that end in one stretch of time, of one salt, as list state, and a timer at the earliest end that emits those that are over.

    Calls to the store are few for each key, not for each lease.  Timers count whole milliseconds.  A
    request that was refused, or whose lease has no end, is not kept, and a lease that is over already
    is emitted at once.
    """

    def __init__(self, fields: str):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leases = handle.getListState("leases", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        over, held, first = [], [], None
        for row in rows:
            lease = tuple(row)[: len(LEASE_FIELDS)]
            if lease[-1] is None:
                continue
            end = _whole_ms(lease)
            if end <= now:
                over.append(lease)
                continue
            first = end if first is None else min(first, end)
            held.append(lease)
            if len(held) == _APPENDED:
                self.leases.appendList(held)
                held = []
        if held:
            self.leases.appendList(held)
        if first is not None:
            self.handle.registerTimer(first)
        return map(_as_row, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        over, rest = [], []
        for lease in self.leases.get() if self.leases.exists() else ():
            (over if _whole_ms(lease) <= now else rest).append(lease)
        if rest:
            self.handle.registerTimer(min(map(_whole_ms, rest)))
        if over:
            self.leases.put(rest) if rest else self.leases.clear()
        return map(_as_row, over)

    def close(self) -> None:
        pass


def _whole_ms(lease: tuple) -> int:
    """The first whole millisecond at which a lease is over."""
    return -(-lease[-1] // 1000)


def _as_row(lease: tuple) -> Row:
    return Row(**dict(zip(LEASE_FIELDS, lease)))


def _leases(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        "lease_id", "role", "db_name", _time("issued", kind).alias("issue_time"), _time("ends", kind).alias("expire_time"), "ttl_secs"
    )


def stream_lease_expiry(
    requests: DataFrame, roles: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Issue leases and emit each one once to ``<path>/expired`` when the stream's time reaches its end.

    The stream's time is Spark's watermark without delay: the latest issue time, in milliseconds, of
    any request of the batches before, also of rejected ones.  It never goes back.  A request that comes
    late is not dropped: its lease ends with the batch if it is over.
    """
    kind = requests.schema["issue_time"].dataType.simpleString()
    timed = requests.withColumn("issue_time", F.col("issue_time").cast("timestamp")).withWatermark("issue_time", "0 seconds")
    judged = governance.judge_requests(timed, roles)
    # All requests go on, so that the filter on refused ones is not moved below the watermark.
    granted = F.col("reason").isNull()
    keyed = judged.select(
        "lease_id", "role", "db_name", "ttl_secs", _micros("issue_time").alias("issued"),
        F.when(granted, _micros("expire_time")).alias("ends"),
    )
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    # Refused ones are dealt by their time of issue, so that they are not all in a few keys.
    stretch, salt = F.floor(F.coalesce("ends", "issued") / STRETCH), F.pmod(F.xxhash64(*LEASE_FIELDS), F.lit(SALTS))
    dealt = keyed.select("*", stretch.alias("stretch"), salt.alias("salt"))
    over = dealt.groupBy("stretch", "salt").transformWithState(LeaseTimers(names), names, "Append", "EventTime")
    writer = _leases(over, kind).writeStream.format("parquet").option("path", f"{path}/expired").outputMode("append")
    return _start_stateful(writer, requests.sparkSession, checkpoint, available_now)


def running_leases(spark: SparkSession, checkpoint: str, kind: str = "timestamp_ntz") -> DataFrame:
    """Leases of :func:`stream_lease_expiry` that its timers have not ended yet."""
    return _leases(_state(spark, checkpoint, "leases").select("list_element.*"), kind)


def expired_leases(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/expired")
    except AnalysisException as err:
        raise LookupError(f"no expired leases below {path}") from err


def stream_tumbling_stats(
    points: DataFrame, path: str, checkpoint: str, window: str, delay: str, available_now: bool = True
) -> StreamingQuery:
    """Count and average per key and tumbling window, emitted when the watermark passes its end.

    ``ts`` is cast, as watermarks need a timestamp with time zone.
    """
    stats = (
        points.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "key")
        .agg(F.count(F.lit(1)).alias("points"), F.avg("value").alias("avg_value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "points", "avg_value")
    )
    writer = stats.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, checkpoint, available_now)
