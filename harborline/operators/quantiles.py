"""Exact quantiles by selection: a mergeable sketch bounds where each lies, and only that band is counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, nan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import MAX_GROUP_ROWS, running, with_group_columns
from harborline.session import stage

#: Size of a key's sketch; a rank it gives is off by about 0.2 hundredths.
SKETCH_SIZE = 2000
#: A band reaches this share of a key's rows to both sides of the quantile.  A band that misses is widened to all rows.
BAND = 0.01


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float],
    band: float = BAND, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles per key; nulls are left out, and NaN comes after all numbers.

    Two passes.  The first sketches the values of each key (KLL, merged on the way to the total), which gives for every quantile
    two values it lies between with near certainty.  The second counts the rows below them as one
    number, and by value only those between them, so what is shuffled and sorted is a small share of
    the rows however many values are distinct.  Whether the band holds the quantile is known from the
    counts; where it does not, that key's rows are counted whole.
    """
    keys, names = list(keys), list(probabilities)
    number = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), number.alias("__d"))
    sketched = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(~F.isnan("__d")).alias("__numbers"),
        F.kll_sketch_agg_double(F.when(~F.isnan("__d"), F.col("__d")), F.lit(SKETCH_SIZE)).alias("__s"),
    )
    bands = []
    for i, name in enumerate(names):
        spot = F.lit(float(probabilities[name])) * (F.col("__n") - 1)
        low, high = probabilities[name] - band, probabilities[name] + band
        bands.append(F.struct(
            F.lit(i).alias("__p"), F.floor(spot).alias("__at"), F.ceil(spot).alias("__next"), (spot - F.floor(spot)).alias("__share"),
            _bound(low, low <= 0, -inf).alias("__low"), _bound(high, high >= 1, nan).alias("__high"),
        ))
    # Written, so that its size is known to the joins and the sketch is made once.
    wanted = stage(sketched.select(*keys, F.explode(F.array(*bands)).alias("__b")).select(*keys, "__b.*"), "quantile-bands")
    found = stage(_select(rows, wanted, keys, max_group_rows), "quantiles")
    missed = found.where("not __held")
    if not missed.isEmpty():
        whole = with_group_columns(wanted, missed.select(*keys, "__p"), [*keys, "__p"])
        whole = whole.withColumns({"__low": F.lit(-inf), "__high": F.lit(nan)})
        found = found.where("__held").unionByName(_select(rows, whole, keys, max_group_rows))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__p") == i, F.col("__value"))).alias(n) for i, n in enumerate(names)])


def _bound(rank: float, is_open: bool, end: float) -> Column:
    """The sketched value at a rank, or the open end; a key of NaN only has no sketch to ask."""
    if is_open:
        return F.lit(end)
    return F.when(F.col("__numbers") == F.col("__n"), F.kll_sketch_get_quantile_double("__s", F.lit(rank))).otherwise(end)


def _select(rows: DataFrame, wanted: DataFrame, keys: list[str], max_group_rows: int) -> DataFrame:
    """``__value`` of every wanted quantile, and ``__held``: whether its places are inside the band."""
    inside = F.col("__d") >= F.col("__low")
    counted = (
        with_group_columns(rows, wanted, keys).where(F.col("__d") <= F.col("__high"))
        .groupBy(*keys, "__p", F.when(inside, 1).otherwise(0).alias("__in"), F.when(inside, F.col("__v")).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    placed = running(
        stage(counted, "quantile-counts"), [*keys, "__p"], ["__in", "__v"], {"__upto": ("sum", F.col("__n"))}, max_group_rows
    )
    joined = with_group_columns(placed, wanted, [*keys, "__p"]).where("__in = 1")

    def value_at(place: str) -> Column:
        hit = (F.col(place) >= F.col("__upto") - F.col("__n")) & (F.col(place) < F.col("__upto"))
        return F.max(F.when(hit, F.col("__v")))

    picked = joined.groupBy(*keys, "__p").agg(
        value_at("__at").alias("__a"), value_at("__next").alias("__z"), F.first("__share").alias("__share")
    )
    between = F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__share")
    every = picked.select(
        *keys, "__p", F.when(F.col("__a") == F.col("__z"), F.col("__a") * F.lit(1.0)).otherwise(between).alias("__value"),
        (F.col("__a").isNotNull() & F.col("__z").isNotNull()).alias("__held"),
    )
    # A band without any row is missing above, and was missed as well.
    renamed = every.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__p"]})
    same = F.lit(True)
    for k in [*keys, "__p"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return wanted.select(*keys, "__p").join(renamed, same, "left").select(
        *keys, "__p", "__value", F.coalesce("__held", F.lit(False)).alias("__held")
    )
