"""The queries of this subpackage: one thin query an operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.llm import compress, divergence, exact, mixing, oracles, packing, quality, rollups, simhash, topk, toxicity, urlrank, vector_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"), min_dedup_bytes=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup_documents(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judge(_table(spark, sf_dir, "pages"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.compress_vectors(_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), digests=True)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_warc": op2_warc,
        "op3_token_counts": op3_token_counts,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_url_filter": op9_url_filter,
        "op10_topk_search": op10_topk_search,
        "op11_vector_codes": op11_vector_codes,
        "op12_divergence": op12_divergence,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query whole; tests hold the others against brute force or held-out labels."""
    return dict(oracles.ORACLES)
