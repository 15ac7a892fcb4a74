"""Recursion over a parent column: roots and depths by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import stage


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``node``, its ``root`` and its ``depth`` below it for every distinct node that is not null.

    A node without a parent, or whose parent is not a node, is a root of depth 0.  Every round joins
    each open node with the one it points to and takes over that one's pointer, so distances double
    and a chain of n nodes takes the logarithm of n rounds, where a join per level takes n.  Nodes that
    have reached their root are not looked up again.  Each round is written, so a lost executor costs
    one round.  Nodes of a cycle, and those below one, have a null root and depth.  Of several parents
    of one node the smallest counts.
    """
    given = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
    known = given.select(F.col("node").alias("parent"))
    linked = stage(given.join(known, "parent", "left_semi").select("node", F.col("parent").alias("at")), "parents")
    tops = given.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("far"))
    parts = [stage(tops.withColumn("done", F.lit(True)), "roots")]
    still = linked.withColumns({"far": F.lit(1).cast("bigint"), "done": F.lit(False)})
    left = total = linked.count()
    reach = 1
    while left and reach <= 2 * total:  # what has not ended by then goes round
        every = reduce(DataFrame.unionByName, [*parts, still])
        ahead = every.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("far").alias("more"), F.col("done").alias("over"))
        moved = still.select("node", "at", "far").join(ahead, "at").select(
            "node", F.col("to").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("over").alias("done")
        )
        moved = stage(moved, "roots")
        parts.append(moved.where("done"))
        still = moved.where("not done")
        left, reach = still.count(), reach * 2
    found = [p.select("node", F.col("at").alias("root"), F.col("far").alias("depth")) for p in parts]
    if left:
        kind = linked.schema["at"].dataType
        found.append(still.select("node", F.lit(None).cast(kind).alias("root"), F.lit(None).cast("bigint").alias("depth")))
    return reduce(DataFrame.unionByName, found)
