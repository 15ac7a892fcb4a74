"""Mix sources to target weights by cutting a random order at exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.prefix import prefix_sums
from harborline.llm.textio import WORD_PATTERN, same
from harborline.session import stage

WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Words to take per source: ``source``, ``source_size``, ``target``.

    Sources in code-point order, null last, weigh ``weights`` repeating and share all words.  A
    target stops at ``max_epochs`` times its source's size; the excess is shared again by weight
    among the others until none is above.  The share per weight only grows from round to round, so
    a source once above stays above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(totals.withColumn("__one", F.lit(1)), [], ["source"], "__one", "__rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = stage(
        ranked.select("source", "source_size", F.get(cycle, (F.col("__rank") % len(weights)).cast("int")).alias("weight")),
        "mix-sources",
    )
    limit, share = F.col("source_size") * max_epochs, 0.0
    while True:
        above = F.col("weight") * F.lit(share) > limit
        words, left, weight = weighed.agg(
            F.sum("source_size"),
            F.sum("source_size") - F.sum(F.when(above, limit).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
        ).first()
        new = left / weight if words and weight else 0.0
        if new <= share:
            break
        share, result = new, (left, weight)
    if share == 0.0:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    target = F.least(limit.cast("double"), F.lit(float(result[0])) * F.col("weight") / F.lit(float(result[1])))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns ``doc_id``, ``source``, ``size`` (words of the text), ``source_size``, ``target`` and
    ``taken``.  Within a source the documents stand in the order of a hash of seed and id.  Whole
    epochs of a source are taken as often as its budget (the target rounded to words) allows; the
    rest goes to the first documents of the order, and the one at the cut gives a part.

    Null and empty texts have size 0 and nothing taken.  Null sources are one source.  Rows with the
    same id are separate documents; ties of the order fall to the text's hash, so reruns agree.
    An empty table gives no rows.  Other columns are ignored.
    """
    sizes = stage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("__key"),
            F.xxhash64("text").alias("__text"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, max_epochs)
    placed = prefix_sums(sizes, ["source"], ["__key", "doc_id", "__text"], "size", "__before")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    # a budget above the source's words is the source whole times over, and a rest
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide(budget, F.col("source_size")))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.least(rest - F.col("__before"), F.col("size")), F.lit(0))
    joined = placed.join(targets, same(placed, targets, ["source"]))
    return joined.select(
        placed["doc_id"], placed["source"], "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS k
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS r FROM s
), c AS (
  SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wgt FROM o
), p AS (
  SELECT lft::DOUBLE AS lft, wgt::DOUBLE AS wgt FROM c WHERE lft::DOUBLE / wgt * w <= 3 * source_size ORDER BY r LIMIT 1
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, p.lft * w / p.wgt) AS target FROM o, p
), b AS (
  SELECT d.doc_id, d.source, d.text, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS bf
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, {columns} size, source_size, target,
       ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
        + greatest(least(budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - bf, size), 0))::BIGINT AS taken
FROM b
"""

