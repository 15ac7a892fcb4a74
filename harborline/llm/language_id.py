"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the labelled sample a dictionary is made from: texts per language, characters per text.
SAMPLE_TEXTS, SAMPLE_CHARS = 64, 2048
DICTIONARY_BYTES = 65536
PIECE_BYTES = 1024
#: Predictions whose best size is below the second best by a smaller share than this are rejected.
MIN_MARGIN = 0.002

#: Letters are Unicode's category L here and in SQL's patterns alike.
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def plain(text: str | None) -> bytes:
    """Lower-cased letters with single blanks between runs of them."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip().encode()


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """Raw-content dictionaries of the labelled ``docs``, the most frequent language first.

    The sample is bounded: per language one text for each of ``texts`` residues of the text's hash, of
    each its first ``chars`` characters (one slice, as any part serves), joined and cut at ``size``
    bytes.  Rows without language or text teach nothing.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # the smallest hash of each of `texts` residues: a bounded sample by plain minima, with no ranking of a language
    least = hashed.groupBy("lang", F.pmod("h", F.lit(texts)).alias("place")).agg(F.min("h").alias("h"))
    sample = (
        labelled.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, chars).alias("text"))
        .join(F.broadcast(least), ["lang", "h"])  # at most `texts` rows per language
        .groupBy("lang", "place").agg(F.min("text").alias("text"))
    )
    joined: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"])):
        joined.setdefault(row["lang"], []).append(plain(row["text"]))
    return [(lang, b" ".join(joined[lang])[:size]) for lang in sorted(joined, key=lambda k: (-counts[k], k))]


def _compressors(model: list[tuple[str, bytes]]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in model:
        known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=len(content), source_size=PIECE_BYTES, min_match=4, write_content_size=0, write_checksum=0,
            write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        known.precompute_compress(compression_params=how)
        made.append((lang, zstandard.ZstdCompressor(dict_data=known, compression_params=how)))
    return made


def classify(text: str | None, coders: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Language and margin: the share by which the best size is below the second best.

    The whole text is compressed in pieces, so that the dictionary counts for long texts too.  At
    equal sizes the language that is more frequent in the labelled rows wins, with margin 0.
    """
    content = plain(text)
    if not content or not coders:
        return UNKNOWN, 0.0
    pieces = [content[i : i + PIECE_BYTES] for i in range(0, len(content), PIECE_BYTES)]
    sizes = [sum(len(coder.compress(p)) for p in pieces) for _, coder in coders]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return coders[best][0], 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    return coders[best][0], 1.0 - sizes[best] / second


def detect(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected`` in place of such columns, in any case.

    Texts that are null or have no letter are ``und``; they and narrow margins are rejected.  Only
    the text decides.  Every row gets its own result; an empty table or model gives none or ``und``.
    """
    fields = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score", "rejected")]
    kept = docs.select(*[f"`{f.name}`" for f in fields])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    place = [f.name.lower() for f in fields].index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _compressors(model)
        for part in parts:
            found = [classify(t.as_py(), coders) for t in part.column(place)]
            extra = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] == UNKNOWN or f[1] < min_margin for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *extra], names=[*part.schema.names, "lang_pred", "score", "rejected"]
            )

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
