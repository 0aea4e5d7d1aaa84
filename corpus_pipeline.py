"""The corpus pipeline: stages over documents, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import mixing, packing, quality, simhash, toxicity
from loam.llm.common import discard, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns from the labelled ones, and there must be some."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train_on(docs, labels, least=1))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones that are left, and there must be some."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_on(docs, labels, least=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five words and 0.8 similarity, that of the smallest id."""
    return simhash.keep_first_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_whole(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token pieces with their ids, packed; ``packing.sequences`` lays them end to end."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained classifiers, iterated links and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage has staged on its way goes when its table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            out = keep(function(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
