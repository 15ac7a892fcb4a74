"""Boilerplate lines: lines that many sites share, found with HyperLogLog sketches per line hash."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.textio import free_name, same
from harborline.session import stage

#: A line on this many different sources is boilerplate.
MIN_SITES = 10
LG_K = 12
#: Lines whose estimate is this many standard errors (and one) from the threshold are counted exactly.
ERRORS = 5
_SEPARATOR = "\n"


def _parts(docs: DataFrame) -> DataFrame:
    """Hash, site and place of every line that is not blank.  A null source is a site of its own."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), site.alias("site"), F.posexplode_outer(F.split("text", _SEPARATOR)).alias("n", "line")
    )
    return lines.where(F.trim("line") != "").select("doc_id", "text_hash", "site", "n", F.xxhash64(F.trim("line")).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` hashes on at least ``min_sites`` sites.

    Each task sketches the sites of its lines and the sketches merge on the way to the total, so a
    line that is everywhere costs a task one sketch.  An estimate near the threshold says too little:
    those lines' sites are counted exactly.
    """
    estimates = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    slack = ERRORS * 1.04 / sqrt(1 << LG_K) * min_sites + 1
    likely = stage(estimates.where(F.col("sites") >= min_sites - slack), "line-sites")
    near = likely.where(F.col("sites") <= min_sites + slack)
    exact = lines.join(near.select("line"), "line").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("sites"))
    sure = likely.where(F.col("sites") > min_sites + slack)
    return sure.select("line").union(exact.where(F.col("sites") >= min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines end at line feeds and are compared without blanks at their ends; blank lines stay.  The
    first occurrence of a boilerplate line (smallest ``doc_id``, null last, then place) stays, so
    that nothing is lost altogether; all later ones go.  ``n_chars`` follows the text if it exists.

    A null text stays null and has no lines.  Texts under one id are told apart by their hash; equal
    rows are treated alike.  Other columns pass through, whatever their names; own ``n_lines`` and
    ``n_removed`` are replaced.  An empty table gives no rows.
    """
    lines = stage(_parts(docs), "lines")
    spread = stage(spread_lines(lines, min_sites), "lines-spread")
    found = lines.join(spread, "line")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")
    # written, so that Spark knows its size and need not bring a frequent line's rows together for the join
    firsts = stage(found.groupBy("line").agg(F.min(place).alias("first")), "lines-first")
    later = found.join(firsts, "line").where(place != F.col("first"))
    removed = later.groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("gone"))
    own_hash, gone = free_name("text_hash", docs), free_name("gone", docs)
    keys = ["doc_id", own_hash]
    base = docs.drop("n_lines", "n_removed").withColumn(own_hash, F.xxhash64("text"))
    removed = removed.withColumnsRenamed({"text_hash": own_hash, "gone": gone})
    joined = base.join(removed, same(base, removed, keys), "left").drop(removed["doc_id"]).drop(removed[own_hash])
    split = F.split("text", _SEPARATOR)

    def rest(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), _SEPARATOR)

    # an array of one binds the lines to a name, so that the text is split once
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(split), rest), F.lit(0)))
    counted = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")).withColumn(
        "n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long")
    )
    out = counted.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(gone, own_hash)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM {documents}
), b AS (
  SELECT trim(line, ' ') AS k, min((doc_id, n)) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1
  HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 10
), r AS (
  SELECT l.*, (b.k IS NOT NULL AND (l.doc_id, l.n) <> b.first) AS gone FROM l LEFT JOIN b ON trim(l.line, ' ') = b.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text
FROM r GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, NULL FROM {documents} WHERE text IS NULL
"""
