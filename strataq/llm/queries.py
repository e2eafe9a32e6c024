"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontamination, hamming_search, line_dedup, mixing, near_dedup, quality, secrets, sharding, substring_dedup, toxicity
from strataq.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = decontamination.covered(F.col("spans")).cast("long")
    out = found.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.85)
    return found.withColumnRenamed("id", "doc_id")


def _scored(spark: SparkSession, sf_dir: str, kind, label: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kind.train(docs, table(spark, sf_dir, "labels"), label=label)
    out = quality.score(docs, model).withColumn("held_out", quality.held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= kind.THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "text", "copy_no")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    digest = F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), n(0), n(1), n(2), digest, secrets.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "shard", "depth", "shard_bytes")


def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % hamming_search.QUERY_EVERY == 0)
    return hamming_search.top_k(vectors, asked)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_near_dedup, op4_quality, op5_line_dedup, op6_mixing, op7_substring_dedup, op8_secrets, op9_sharding, op10_hamming_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.oracle_sql(), "op5_line_dedup": line_dedup.oracle_sql(), "op6_mixing": mixing.oracle_sql(), "op9_sharding": sharding.oracle_sql(), "op10_hamming_search": hamming_search.oracle_sql()}
