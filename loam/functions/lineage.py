"""Cutting the lineage of tables that are read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if need be.

    A local session without such a folder gets a temporary one; a cluster must name one in spark.checkpoint.dir.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loam-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once, in the session's checkpoint folder, for all that read it later."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """Like :func:`settle`, but as a table that :func:`release` can delete: for what one round leaves to the next."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote and that nothing lazy reads any more; other ones stay."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            df.staged_at = None


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``place``: each row's number from 1 in its group, by ``order``.

    A range sort over group and order; each range is numbered from where those before it end, so that a group of any
    size is spread over tasks. What meets in one place is a row for each range and group that begins or ends there.
    """
    keys = [*group, *order]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The upper bits of this number are the partition, the lower 33 the row in it.
    rows = settle(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = rows.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    starts = runs.select(F.col("part").alias("of"), *[F.col(g).alias(f"of_{g}") for g in group], shift.alias("shift"))
    same = [F.col("part") == F.col("of"), *[F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]]
    return rows.join(starts, same).select(*df.columns, (F.col("at") + F.col("shift")).alias("place"))


def firsts(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in ``order``; each task cuts its own share before any row moves."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over its rows up to and including this one in ``order``.

    The order must tell all rows apart, so the sums do not depend on how rows are laid out. A range sort spreads the
    rows over tasks; sums inside a range start from where those before it end, one row a range.
    """
    rows = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    starts = rows.groupBy(F.col("_part").alias("_of")).agg(F.sum(value).alias("_sum"))
    starts = starts.select("_of", F.coalesce(F.sum("_sum").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(starts), F.col("_part") == F.col("_of")).withColumn(name, F.col("_start") + F.sum(value).over(inside)).select(*df.columns, name)
