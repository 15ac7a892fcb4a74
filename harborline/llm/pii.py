"""Personal data: fixed forms as seeds, and more identifiers from the contexts that the seeds share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.textio import same
from harborline.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Forms an unseen identifier may have, each its own kind of span.
SHAPES = ("number", "address", "code")
#: Rounds of scoring in a generation, seeds a pattern needs, and the score from which it finds identifiers.
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 5, 0.9
#: Characters beside a match in which its neighbouring words are looked for.
CONTEXT = 64

# Each form is the plain one with possessive parts and, where a run could be tried from each of its
# characters, a look-behind; so matches are the same and no text takes quadratic time.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SHAPE = {
    "number": r"(?<![0-9A-Za-z.+])[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "address": r"(?<![^\s<(\[\x22'])[^\s@<>()\[\]\x22',;]++@[^\s@<>()\[\]\x22',;]++",
    "code": r"(?<![0-9A-Za-z_/=+.@-])(?:[A-Za-z]++(?:[-/]?[0-9]++)[A-Za-z0-9-]*+|[0-9]++-?[A-Za-z]++[A-Za-z0-9-]*+)(?![0-9A-Za-z_/=+.@])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "code":
        return F.length(match).between(6, 40)
    return F.lit(True)


def _matches(kind: str, pattern: str) -> Column:
    """Array of all matches of one form in ``text``, with what stands between and beside them.

    Splitting at the form gives what lies between its matches; places are sums of these lengths.
    """
    pieces, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
    zipped = F.arrays_zip(
        found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("l"), F.slice(pieces, 2, F.size(found)).alias("r")
    )
    listed = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("text"), F.length(x["l"]).alias("gap"),
            F.right(x["l"], F.lit(CONTEXT)).alias("left"), F.left(x["r"], F.lit(CONTEXT)).alias("right"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,i:int,text:string,gap:int,left:string,right:string>>")
    return F.coalesce(F.when(F.col("text").rlike(pattern), listed), none)


def occurrences(docs: DataFrame) -> DataFrame:
    """Base matches (``base`` true), and matches of the open shapes that touch none of them.

    One pass over the texts looks for all forms.
    """
    forms = {**_BASE, **_SHAPE}
    # outer, as for a plain explode Spark would evaluate the arrays again to drop empty ones first
    every = F.explode_outer(F.flatten(F.array(*[_matches(k, p) for k, p in forms.items()]))).alias("x")
    rows = docs.select("doc_id", "text_hash", every).select("doc_id", "text_hash", "x.*").where("kind IS NOT NULL")
    rows = rows.dropDuplicates(["doc_id", "text_hash", "kind", "i"])
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("text")).over(upto).cast("int")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
    valid = F.lit(False)
    for kind in forms:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("text"))).otherwise(valid)
    both = placed.where(valid).withColumn("base", F.col("kind").isin(*_BASE)).drop("i", "gap")
    text = Window.partitionBy("doc_id", "text_hash")
    earlier = text.orderBy("start", F.col("base").desc(), "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # from the end, as Spark evaluates a frame that is open to the end anew for every row
    behind = text.orderBy(F.col("start").desc(), "base", F.col("end").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    later = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    free = (F.coalesce(until, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    return both.withColumn("__free", free).where(F.col("base") | F.col("__free")).drop("__free")


def _edges(found: DataFrame) -> DataFrame:
    """Pairs of lexical pattern and instance, once each.  Patterns are the words beside a match."""
    one, two = F.regexp_extract(F.lower("left"), r"(\S+)\s*$", 1), F.regexp_extract(F.lower("left"), r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(F.lower("right"), r"^\s*(\S+)", 1)
    patterns = F.array(
        F.when(one != "", F.concat(F.lit("1 "), one)),
        F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " "))),
        F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("3"), one, F.lit("_"), after)),
    )
    return found.withColumn("pattern", F.explode(F.filter(patterns, lambda p: p.isNotNull())))


def _scores(graph: DataFrame) -> DataFrame:
    """``trust`` and ``seeds`` of every pattern after ``ROUNDS`` rounds over the graph."""
    scored = graph.withColumn("score", F.col("seed").cast("double"))
    for step in range(ROUNDS):
        scores = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("seeds")
        )
        patterns = stage(scores, "pii-patterns")
        if step == ROUNDS - 1:
            break
        trust = F.when(F.col("seeds") >= MIN_SEEDS, F.col("trust")).otherwise(0.0)
        instances = (
            graph.where("not seed").join(patterns, "pattern").groupBy("instance").agg(F.avg(trust).alias("mean"))
        )
        scored = graph.join(instances, "instance", "left").withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0)))
        )
    return patterns


def confident_patterns(edges: DataFrame) -> DataFrame:
    """Patterns with a score of ``MIN_SCORE`` or more, found generation by generation.

    ``edges`` has ``pattern``, ``instance`` and ``seed``.  A pattern scores the sum of its instances'
    scores over their number and one; it needs ``MIN_SEEDS`` seeds.  A seed scores one, any other
    instance the mean of its patterns, nothing at first.  The instances of confident patterns are
    seeds of the next generation, until none adds a pattern; seeds only raise scores, so a pattern once
    confident stays so.
    """
    graph = stage(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    known = 0
    while True:
        confident = _scores(graph).where((F.col("seeds") >= MIN_SEEDS) & (F.col("trust") >= MIN_SCORE)).select("pattern")
        count = confident.count()
        if count == known:
            return confident
        known = count
        accepted = graph.join(confident, "pattern", "left_semi").select("instance").distinct().withColumn("accepted", F.lit(True))
        joined = graph.join(accepted, "instance", "left")
        graph = stage(joined.select("pattern", "instance", (F.col("seed") | F.col("accepted").isNotNull()).alias("seed")), "pii-graph")


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every document: ``doc_id``, ``text_hash`` and ``spans``.

    Spans have kind, start, end (code points, end exclusive), base and text, by kind in the order of
    ``KINDS`` and ``SHAPES``, then start.  Base kinds are fixed forms.  Their matches are the seeds:
    the words beside them are patterns, patterns and instances score each other, and patterns that
    nearly always stand beside seeds add the matches of open shapes that they stand beside.  What was
    added supports further patterns in turn.

    One row per input row: null and empty texts have no spans, equal rows have equal spans.  Other
    columns are ignored; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = stage(occurrences(texts), "pii-found")
    instance = F.concat_ws(" ", F.when(F.col("base"), F.lit("seed")).otherwise(F.col("kind")), F.lower("text"))
    edges = _edges(found)
    trusted = confident_patterns(edges.select("pattern", instance.alias("instance"), F.col("base").alias("seed")))
    names = ["doc_id", "text_hash", "kind", "start", "end", "text", "base"]
    added = edges.where("not base").join(trusted, "pattern", "left_semi").select(*names).distinct()
    spans = found.where("base").select(*names).union(added)
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *SHAPES)]), F.col("kind"))
    listed = spans.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base", "text"))).alias("spans")
    )
    rows = texts.select("doc_id", "text_hash")
    joined = rows.join(listed, same(rows, listed, ["doc_id", "text_hash"]), "left")
    tidy = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                   s["base"].alias("base"), s["text"].alias("text")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,text:string>>")
    return joined.select(rows["doc_id"], rows["text_hash"], F.coalesce(tidy, none).alias("spans"))
