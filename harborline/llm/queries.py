"""The dealt operators as queries over the given tables, each with the SQL it must equal where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import (
    cap_filters, contamination, hard_negatives, language_id, line_dedup, masked_lm, mixing, pii, ranked_search, repeats, secret_scan,
    simhash, url_filter,
)
from harborline.llm.textio import span_count, span_digest
from harborline.sources.tables import table


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.where(~held_out).select("lang", "text"))
    found = language_id.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, root, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op3_pii(spark: SparkSession, root: str) -> DataFrame:
    found = pii.find_pii(table(spark, root, "documents"))
    return found.select(
        "doc_id",
        *[span_count("spans", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(span_digest("spans", pii.KINDS), 256).alias("base_sha256"),
        span_digest("spans").alias("spans"),
    )


def op4_masked_lm(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return masked_lm.score(docs, masked_lm.train(docs))


def op5_repeats(spark: SparkSession, root: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, root, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = contamination.contained_items(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.drop("text_hash")


def op7_simhash(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, root, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_embeddings(spark: SparkSession, root: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, root, "embeddings"))


def op10_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, root, "documents"))
    return found.select(
        "doc_id",
        *[span_count("spans", k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(span_digest("spans", secret_scan.KINDS), 256).alias("base_sha256"),
        span_digest("spans").alias("spans"),
    )


def op11_url_filters(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge(table(spark, root, "pages")).drop("pattern")


def op12_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranked_search.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, root, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


LLM_QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_masked_lm": op4_masked_lm,
    "op5_repeats": op5_repeats,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash": op7_simhash,
    "op8_mix_sources": op8_mix_sources,
    "op9_embeddings": op9_embeddings,
    "op10_secrets": op10_secrets,
    "op11_url_filters": op11_url_filters,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

LLM_ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE.format(documents="documents"),
    "op6_benchmark_decontamination": contamination.ORACLE,
    "op8_mix_sources": mixing.ORACLE.format(documents="documents", columns=""),
    "op11_url_filters": url_filter.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
