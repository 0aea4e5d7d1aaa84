"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash of what is left.

Texts are equal when they are the same after ASCII white space is deleted. A row whose length and prefix no other row
has is alone, and its content is never hashed. Texts are never shuffled: what a second scan must hash reaches it as a
table of hash buckets of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import join_groups, stage

#: Lengths and prefixes that repeat are known to the second scan by these many buckets; one bucket more costs a hash.
BUCKETS = 1 << 18


def without_space(text: Column) -> Column:
    """The text without ASCII white space; a null one is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame, prefix: int = 64, digests: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs`` (``doc_id, text``).

    Of equal texts the row of the most code points, white space included, stays, then that of the smallest id (null
    last); ``keep_id`` is its id. One row of a group is ``kept``: of rows that repeat both, any one.
    ``text_sha256`` is the hash by which the row was compared, null for a row that is alone by length and prefix;
    ``digests`` asks for it there too.

    The first scan counts lengths and hashes of the first ``prefix`` characters, the second one hashes the whole
    contents of rows that share both. Groups are counted by partial sums, and those of many rows, which are few, are
    joined by broadcast.

    Edge cases: a null text is empty; all empty texts are one group; an empty table gives no rows; other columns are
    ignored.
    """
    bare = without_space(F.col("text"))
    shape = [F.length(bare).alias("length"), F.xxhash64(F.substring(bare, 1, prefix)).alias("head")]
    bucket = F.pmod(F.xxhash64("length", "head"), F.lit(buckets)).alias("bucket")
    shared = docs.select(*shape).groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1")
    seen = stage(shared.select(bucket).distinct(), "shapes")  # at most BUCKETS numbers

    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), bare.alias("bare"))
    rows = rows.select("doc_id", "chars", "bare", F.length("bare").alias("length"), F.xxhash64(F.substring("bare", 1, prefix)).alias("head"))
    met = rows.withColumn("bucket", bucket).join(F.broadcast(seen.withColumn("shared", F.lit(True))), "bucket", "left")
    full = F.sha2("bare", 256)
    rows = met.select(
        "doc_id", "chars", F.col("shared").isNull().alias("alone"), (full if digests else F.when(F.col("shared"), full)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "hashed")
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep")))
    grouped = rows.where("not alone").groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = stage(grouped.select("text_sha256", "group_size", "best.keep_id", "best.keep"), "copies")
    met = join_groups(rows.where("not alone"), groups, ["text_sha256"], "group_size")
    met = met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep")).alias("kept"), "text_sha256")
    alone = rows.where("alone").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return met.unionAll(alone)
