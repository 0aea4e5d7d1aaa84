"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.plans import code_queries, text_queries, wiki_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and cosine lists fused by rank and boosted."""
    return text_queries.hybrid_metadata_boost(spark, sf_dir)


def queries() -> dict[str, Query]:
    return text_queries.QUERIES | code_queries.QUERIES | wiki_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | code_queries.SQL | wiki_queries.SQL
