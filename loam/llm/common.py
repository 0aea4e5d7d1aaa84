"""What the operators of this subpackage share: staged tables and word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (Java regex and RE2 agree on it).
WORD = r"[^\x20\x09-\x0D]+"

_local_root: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "root" not in _local_root:
        _local_root["root"] = tempfile.mkdtemp(prefix="loam-")
        atexit.register(shutil.rmtree, _local_root["root"], ignore_errors=True)
    return "file://" + _local_root["root"]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"


_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete, at the end, the tables that were staged inside, but for those staged by the function that it gives.

    Nothing lazy that reads the others may be left by then.
    """
    before, kept = len(_staged), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_staged.pop())
        return out

    try:
        yield keep
    finally:
        for path in _staged[before:]:
            Store(spark, path).delete(path)
        _staged[before:] = kept


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the group's rows up to and including this one in ``order``.

    The order must tell all rows of a group apart. A range sort spreads groups of any size over tasks; sums inside a
    range start from where the ranges before it end, for which a row for each range and group meets in one place.
    """
    keys = [*map(F.col, group), *order]
    added = df.withColumns({f"_{n}": c for n, c in sums.items()})
    rows = stage(added.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_part", *group).agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(F.col("_part").alias("_of"), *[F.col(g).alias(f"_of_{g}") for g in group], *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_ahead_{n}") for n in sums])
    same = [F.col("_part") == F.col("_of"), *[F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]]
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumns({f"_in_{n}": F.sum(f"_{n}").over(inside) for n in sums}).join(ahead, same)
    return laid.select(*df.columns, *[(F.col(f"_ahead_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, parts: int = 2000) -> DataFrame:
    """Each row beside its group, for groups of any size; null keys meet null keys.

    ``groups`` has one row a key, with the number of the key's rows in ``size``. Groups of more than a ``parts``-th of
    all rows, of which there are fewer than ``parts``, are sent to every task; the other ones meet their rows in a join
    on the key, where none of them can fill a partition. Rows without a group are left out.
    """
    line = (groups.agg(F.sum(size)).first()[0] or 0) // parts
    named = groups.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    large = F.broadcast(named.where(F.col(size) > line))
    hot = rows.join(large, same)
    rest = rows.join(large.select(*[f"_of_{c}" for c in on]), same, "left_anti").join(named.where(F.col(size) <= line), same)
    return hot.unionAll(rest).drop(*[f"_of_{c}" for c in on])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches of whole texts to ``rows`` rows, so that a Python worker's memory stays bounded.

    A setting of the session: what is computed lazily is computed after this returns, so it is not taken back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_kept: dict[str, object] = {}


def worker_cache(key: str, make: Callable[[], object]) -> object:
    """The one cache that a Python worker keeps between batches and tasks: asking for another drops it.

    Workers outlive queries, and several caches of a million words would outgrow an executor's memory.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stage` wrote and that nothing lazy reads any more."""
    for path in {p for p in _staged for f in df.inputFiles()[:1] if p.rpartition("/")[2] in f}:
        Store(df.sparkSession, path).delete(path)
        _staged.remove(path)


class Store:
    """The few file operations that Spark's readers and writers lack, through the Hadoop client they use themselves."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def make_dir(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def publish(self, temporary: str, final: str) -> bool:
        """Rename a finished folder; False, and the folder deleted, if the final name is there already.

        Of two that rename at once the later one ends up inside the first one's folder, under its own name; if that
        begins with ``_``, no reader sees it there, and it is deleted again.
        """
        target, own = self._path(final), self._path(temporary)
        self._fs.mkdirs(target.getParent())
        if not self._fs.exists(target) and self._fs.rename(own, target):
            inside = self._path(target, own.getName())
            if not self._fs.exists(inside):
                return True
            self._fs.delete(inside, True)
        self._fs.delete(own, True)
        return False

    def move_all(self, moves: list[tuple[str, str]], threads: int = 16) -> None:
        """Rename files one by one; nothing is read."""
        with ThreadPoolExecutor(threads) as pool:
            for done, (old, new) in zip(pool.map(lambda m: self._fs.rename(self._path(m[0]), self._path(m[1])), moves), moves):
                if not done:
                    raise OSError(f"{old} cannot be renamed to {new}")
