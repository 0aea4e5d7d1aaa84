"""Best-fit packing of tokenized documents: partitions pack locally, then a tree merges the bins that stay underfull."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import small_batches, stage
from loam.llm.tokens import default_path, word_tokenizer

CAPACITY = 2048
#: The id after each document.
END = 0


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and its offset there, and each bin's fill.

    An item goes into the open bin with the least room that holds it. Bit r of ``rooms`` says whether some bin has
    room r, so finding that bin is one shift whatever the number of bins.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each document's ids and an end, cut at ``capacity``."""
    path, kind = tokenizer or default_path(), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).ids
        for batch in batches:
            rows, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(row)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(len(part))
                    sums.append(crc32(part.tobytes()))
                    kept += [part] * keep_ids
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
            columns += [pa.array(kept, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _pack_partitions(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """``items`` with ``bin, offset, fill``: each partition packs the column ``length`` of its rows by best fit.

    A bin's number holds the level (its 5 upper bits, far more than a tree of ``fan_in`` can have), the partition and a
    count, so that numbers never meet.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            table = pa.Table.from_batches(got)
            bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
            first = (level << 58) + (TaskContext.get().partitionId() << 32)
            for name, column in (("bin", bins + first), ("offset", offsets), ("fill", fills[bins])):
                table = table.append_column(name, pa.array(column, pa.int64()))
            yield from table.to_batches(max_chunksize=10_000)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(pack, f"{kinds}, bin long, offset long, fill long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 32, fan_in: int = 8, most: int = 500_000) -> DataFrame:
    """``pieces`` (with ``length``) and their ``sequence_id`` and ``offset``: best fit in each partition, then a merge tree.

    Bins with at most ``slack`` ids of room are done. Each further round takes the others as single items, joins
    ``fan_in`` partitions into one (not beyond about ``most`` items, so that a task's memory is bounded at any size)
    and packs again, until one partition has packed all that is left. Where more than ``most`` open bins are left to
    the last tasks, they are dealt anew and packed once more: each task then ends with at most one bin that
    is not half full. Every round is a staged table; at the end the rounds' few bins are composed and joined to the
    pieces once.
    """
    first = stage(_pack_partitions(pieces, 0, capacity), "packed")
    rounds, last, parts = [], first, first.rdd.getNumPartitions()
    for level in count(1):
        left = last.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack))
        items = left.select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        open_bins = items.count()
        fewer = max(-(-parts // fan_in), -(-open_bins // most), 1)
        done = fewer == 1 or fewer >= parts
        if open_bins < 2:
            break
        dealt = items.coalesce(fewer) if fewer < parts or fewer == 1 else items.repartition(fewer, F.xxhash64("item", F.lit(level)))
        last = stage(_pack_partitions(dealt, level, capacity), f"merged{level}")
        rounds.append(last.select("item", F.col("bin").alias("into"), F.col("offset").alias("moved")))
        if done:
            break
        parts = fewer
    placed = first.drop("fill")
    if rounds:
        placed = placed.join(reduce(_compose, reversed(rounds)), placed["bin"] == F.col("item"), "left")
        placed = placed.withColumn("bin", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("moved", F.lit(0)))
    return placed.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")


def _compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Where the items of ``earlier`` end up when its bins are the items of ``later``."""
    then = later.select(F.col("item").alias("bin"), F.col("into").alias("final"), F.col("moved").alias("more"))
    joined = earlier.join(then, F.col("into") == F.col("bin"), "left")
    return joined.select("item", F.coalesce("final", "into").alias("into"), (F.col("moved") + F.coalesce("more", F.lit(0))).alias("moved"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece of every row.

    Edge cases: a null or blank text is the end id alone; a text of more than ``capacity`` ids becomes several
    pieces, packed separately; null and repeated ``doc_id`` are packed row by row; an empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    cut = cut_pieces(docs, tokenizer, capacity, keep_ids)
    pieces = stage(cut.withColumn("row", F.monotonically_increasing_id()) if keep_ids else cut, "pieces")
    # Dealt by hash, so that every partition packs the whole mix of lengths however the documents lie.
    own = ["doc_id", "piece", "ids_crc32", *["row"] * keep_ids]
    slim = pieces.drop("ids").repartition(max(1, pieces.rdd.getNumPartitions()), *own).sortWithinPartitions(*own)
    packed = pack_pieces(slim, capacity)
    return packed.join(pieces.select("row", "ids"), "row").drop("row") if keep_ids else packed


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed pieces (with ``ids``) laid end to end.

    Edge cases: a sequence has at least one piece, and each piece at least the end id, so no row is empty; repeated
    documents stand as often as they were packed; no pieces give no rows; other columns are ignored.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
