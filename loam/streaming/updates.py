"""Structured Streaming: windowed event counts with late data, and files followed by state for each path."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from loam.sources import store
from loam.sources.files import read_or_empty

CHANGES = "path string, change string, hash string, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` of tumbling windows; a stream gives up on rows later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


class _Followed(StatefulProcessor):
    """The last known hash of a path and when it was seen, with a timer for when it counts as gone; times are microseconds."""

    def __init__(self, gone_after: int | None) -> None:
        self.gone_after = gone_after

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hash string, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = before = tuple(self.known.get()) if self.known.exists() else None
        for us, there, digest in sorted((r.us, r.hash is not None, r.hash or "") for r in rows):
            if known and (us, there, digest) < (known[1], True, known[0]):
                continue
            if known and self.gone_after and us > known[1] + self.gone_after:
                yield Row(path=key[0], change="removed", hash=None, us=known[1] + self.gone_after)
                known = None
            if there and (known is None or known[0] != digest):
                yield Row(path=key[0], change="changed" if known else "added", hash=digest, us=us)
            elif known and not there:
                yield Row(path=key[0], change="removed", hash=None, us=us)
            known = (digest, us) if there else None
        if known == before:
            return
        if self.gone_after and before:
            self.handle.deleteTimer(self._due(before[1]))
        if known is None:
            self.known.clear()
            return
        self.known.update(known)
        if self.gone_after:
            self.handle.registerTimer(self._due(known[1]))

    def _due(self, us: int) -> int:
        """The first whole millisecond after a path is gone: no sighting that is still on time can undo it then."""
        return (us + self.gone_after) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists():
            yield Row(path=key[0], change="removed", hash=None, us=self.known.get()[1] + self.gone_after)
            self.known.clear()

    def close(self) -> None:
        pass


def file_changes(sightings: DataFrame, gone_after: timedelta | None = None, late: str = "10 minutes") -> DataFrame:
    """``path, change, hash, at``: what a stream of sightings (``path, hash, seen``) says of its files.

    A path is added when it is first seen, changed when its hash differs from the last one, and removed when a
    sighting has no hash or when none came for ``gone_after``, at that moment. State is one row a path, and a batch
    reads and writes that of its own paths alone. Changes do not depend on how sightings fall into batches, as long as
    each path's come in order of time and no later than ``late``.

    Sightings older than the path's last one say nothing new. At one time the greatest hash counts last, and a
    sighting without a hash first. Rows without a path or a time are left out. A batch's sightings of one path meet
    in one task. Sets the session's state store to RocksDB, which such state needs.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    us = F.unix_micros(F.col("seen").cast("timestamp")).alias("us")
    rows = sightings.select("path", "hash", F.col("seen").cast("timestamp").alias("seen"), us).where("path is not null and seen is not null")
    rows = rows.withWatermark("seen", late) if gone_after else rows
    mode = "EventTime" if gone_after else "None"
    gone = gone_after and gone_after // timedelta(microseconds=1)
    found = rows.groupBy("path").transformWithState(_Followed(gone), "path string, change string, hash string, us long", "Append", mode)
    return found.select("path", "change", "hash", F.timestamp_micros("us").alias("at"))


def follow_files(
    files: DataFrame, root: str, checkpoint: str, on_change: Callable[[DataFrame, int], None],
    gone_after: timedelta | None = None, late: str = "10 minutes", once: bool = False,
) -> StreamingQuery:
    """Keep the changes of followed files under ``root`` and pass each micro-batch's (``path, change``) on.

    ``files`` has ``path, hash`` and, if ``seen`` is not there, is taken as seen when its batch begins. A batch writes
    the changes it found, under its own number, and overwrites only that, so a batch that is run again gives the same;
    :func:`manifest` folds them. ``once`` stops when all that is there has been read.
    """
    rows = files if "seen" in files.columns else files.withColumn("seen", F.current_timestamp())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/version={number}")
        found = read_or_empty(batch.sparkSession, f"{root}/changes/version={number}", CHANGES)
        on_change(found.select("path", "change"), number)

    writer = file_changes(rows, gone_after, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash`` of the files there now: the last change of each path since the last fold, and what that left."""
    return _folded(spark, root, None).where("hash is not null").select("path", "hash")


def _folded(spark: SparkSession, root: str, upto: int | None) -> DataFrame:
    folds = _folds(spark, root)
    base = folds[-1] if folds else -1
    later = read_or_empty(spark, f"{root}/changes", f"{CHANGES}, version long").where(F.col("version") > base)
    later = later if upto is None else later.where(F.col("version") <= upto)
    old = read_or_empty(spark, f"{root}/folds/upto={base}", CHANGES).withColumn("version", F.lit(base).cast("long"))
    # Of changes at one time a removal is the earlier one: what is gone at a moment may be seen again at it.
    order = F.struct("version", "at", F.col("hash").isNotNull(), "hash")
    last = old.unionByName(later).groupBy("path").agg(F.max_by(F.struct("change", "hash", "at"), order).alias("c"))
    return last.select("path", "c.change", "c.hash", "c.at")


def _folds(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix("upto=")) for n in store.names(spark, f"{root}/folds") if n.startswith("upto="))


def fold_changes(spark: SparkSession, root: str, upto: int) -> None:
    """Fold the changes up to a finished batch into one table, which :func:`manifest` then starts from.

    It appears by one rename, so readers see the old fold or the new one; a fold that is there already stays.
    """
    folds = _folds(spark, root)
    if not folds or folds[-1] < upto:
        store.write_once(_folded(spark, root, upto).where("hash is not null"), f"{root}/folds/upto={upto}")
