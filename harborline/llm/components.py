"""Connected components of a graph given as pairs of 64-bit node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges``.

    Rounds of hanging a node's larger neighbours, then its smaller ones, below its smallest
    neighbour, until the pairs no longer change and form stars.  Rounds grow with the logarithm of a
    component's size.  Every step is a join or a minimum per node, and each round is written, so a
    lost executor costs one round.  Loops and repeated pairs do no harm; no pairs give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        pairs = stage(pairs, "components")
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select("v", "v").distinct()
            )
        seen = state
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = hung.union(low.select("u", F.col("m").alias("v"))).distinct()
