"""Counters, gauges and histograms as aggregates over event or log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.topn import latest_per_key

# Upper bounds, in seconds, of the query duration histogram.
DURATION_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def labelled_counter(events: DataFrame, label: str) -> DataFrame:
    return events.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("total"))


def bucket_index(value: Column, bounds: Sequence[float]) -> Column:
    """Position of the first bound ``>= value``; ``len(bounds)`` stands for +Inf."""
    index = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        index = F.when(value <= F.lit(bounds[i]), F.lit(i)).otherwise(index)
    return index


def bucket_counts(events: DataFrame, label: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """Observations per label and (not yet cumulative) bucket."""
    return (
        events.where(F.col(value).isNotNull())
        .groupBy(F.col(label).alias("label"), bucket_index(F.col(value), bounds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    )


def cumulate_buckets(counts: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` buckets with the label's total count and sum.

    The input is the small bucket table: at most ``len(bounds) + 1`` rows per label.  Each row
    spells out all bounds, so buckets nothing fell into appear as well.
    """
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    every = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("le_index", "le")
    return (
        counts.select("label", "bucket", "n", "s", every)
        .groupBy("label", "le_index", "le")
        .agg(
            F.coalesce(F.sum(F.when(F.col("bucket") <= F.col("le_index"), F.col("n"))), F.lit(0)).alias("cumulative"),
            F.sum("n").alias("total_count"),
            F.sum("s").alias("total_sum"),
        )
    )


def cumulative_histogram(
    events: DataFrame, label: str, value: str, bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    return cumulate_buckets(bucket_counts(events, label, value, bounds), bounds)


def total(events: DataFrame, column: str) -> DataFrame:
    """Monotone total of non-negative increments."""
    return events.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def gauge_last(events: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Gauge that is set: the latest value per key."""
    return latest_per_key(events, key, ts, tie, value).select(
        F.col(key).alias("key"), F.col("latest").alias("gauge")
    )


def gauge_net(events: DataFrame, key: str, delta: Column) -> DataFrame:
    """Gauge that is added to and subtracted from: the net of all changes per key."""
    return events.groupBy(F.col(key).alias("key")).agg(F.sum(delta).alias("gauge"))


def _label_text(value: Column) -> Column:
    """Label values escape backslash, line feed and double quote."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def exposition_header(name: str, kind: str, about: str) -> list[str]:
    """The HELP and TYPE lines of a metric."""
    text = about.replace("\\", "\\\\").replace("\n", "\\n")
    return [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]


def exposition_histogram(histogram: DataFrame, name: str, label: str) -> DataFrame:
    """Text lines of a :func:`cumulative_histogram`: a bucket per bound, then sum and count per label."""
    pair = F.concat(F.lit(f'{label}="'), _label_text(F.col("label")), F.lit('"'))
    bucket = F.concat(F.lit(f"{name}_bucket{{"), pair, F.lit(',le="'), "le", F.lit('"} '), F.col("cumulative").cast("string"))
    last = [
        F.concat(F.lit(f"{name}_{part}{{"), pair, F.lit("} "), F.col(column).cast("string"))
        for part, column in (("sum", "total_sum"), ("count", "total_count"))
    ]
    lines = F.when(F.col("le") == "+Inf", F.array(bucket, *last)).otherwise(F.array(bucket))
    return histogram.select(F.explode(lines).alias("line"))


def exposition_lines(samples: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """One text line per sample: ``name{label="value",...} number``."""
    pairs = [F.concat(F.lit(f'{label}="'), _label_text(F.col(label)), F.lit('"')) for label in labels]
    head = F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} ")) if labels else F.lit(name + " ")
    return samples.select(F.concat(head, F.col(value).cast("string")).alias("line"))
