"""The few file operations that Spark's readers and writers lack, through the Hadoop client they use themselves."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing where it is missing."""
    store, at = _opened(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    store, at = _opened(spark, path)
    store.delete(at, True)


def walk(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """Path under ``root`` and size of every file below it, one by one."""
    store, at = _opened(spark, root)
    base = store.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    found = store.listFiles(at, True)
    while found.hasNext():
        status = found.next()
        yield status.getPath().toUri().getPath().removeprefix(base), status.getLen()


def content(spark: SparkSession, path: str) -> bytes | None:
    """A file's bytes, null where it cannot be read."""
    store, at = _opened(spark, path)
    try:
        stream = store.open(at)
    except Exception:  # the store's own errors, of which there is no list
        return None
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table that appears whole, by one rename; False, and nothing changes, if ``path`` is there already.

    Of two that rename at once the later one ends up inside the first one's folder, under a name that readers skip; it
    is deleted again.
    """
    spark = df.sparkSession
    store, final = _opened(spark, path)
    own = f"_{uuid.uuid4().hex}"
    temporary = _opened(spark, f"{path.rpartition('/')[0]}/{own}")[1]
    df.write.parquet(temporary.toString())
    if not store.exists(final) and store.rename(temporary, final):
        inside = _opened(spark, f"{path}/{own}")[1]
        if not store.exists(inside):
            return True
        store.delete(inside, True)
    store.delete(temporary, True)
    return False


def file_signature(df: DataFrame) -> str:
    """Names, sizes and times of the files that a table is read from: another signature means other rows."""
    parts = []
    for file in sorted(df.inputFiles()):
        store, at = _opened(df.sparkSession, file)
        status = store.getFileStatus(at)
        parts.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]
