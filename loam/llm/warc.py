"""WARC archives: a deterministic sharded writer with payload revisits, and a reader.

The archive is a folder: ``data/`` holds gzip WARC files with a member for each record, ``manifest/`` a Parquet table
with a row for each file. A file counts only if the manifest names it.

Spark's text writer writes the files, so they go to any store that Spark can write, and of several attempts of a task
one alone is committed. It writes each row's bytes as they are and ends them with ``lineSep``: here a zero byte, which
is what every gzip member of less than 16 MiB of content ends with anyway.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import Store, fresh_dir, running, small_batches, stage

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry this date unless the caller gives one: equal input makes equal bytes.
EPOCH = "1970-01-01T00:00:00Z"


def _digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode("utf-8", "replace")


def one_line(url: str) -> str:
    """The url as a header can hold it: line breaks and blanks at its ends percent-encoded, nothing else changed."""
    return re.sub(r"^\s+|\s+$|[\r\n]", lambda m: quote(m[0]), url)


def record_id(page_id: int | None, url: str | None, digest: str, repeat: int) -> str:
    """The same for equal input and another for each record: ``repeat`` counts rows alike in all three."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{repeat}|{url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, repeat: int, date: str, of: tuple[int | None, str | None] | None = None) -> bytes:
    """One record: an HTTP response, or a revisit of the response ``of`` a page id and url, with its HTTP headers alone."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if of else http + payload
    fields = [("WARC-Type", "revisit" if of else "response"), ("WARC-Record-ID", record_id(page_id, url, digest, repeat)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", one_line(url))] if url else []
    fields += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if of:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*of, digest, 0)), ("WARC-Refers-To-Date", date)]
        fields += [("WARC-Refers-To-Target-URI", one_line(of[1]))] if of[1] else []
        fields += [("WARC-Refers-To-Page-ID", str(of[0]))] if of[0] is not None else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _closing(file: str, date: str) -> bytes:
    """A record without content, for the end of a file whose last member does not end with a zero byte."""
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'end of {file}')}>"
    fields = [("WARC-Type", "metadata"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]
    return _header(fields, "WARC/1.1") + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # no name, no time: equal data gives equal bytes
    return packer.compress(data) + packer.flush()


def _sort_key(page_id: Column, digest: Column) -> Column:
    """Text that sorts as (page_id, digest), null ids first."""
    shifted = F.lpad(F.hex(F.col("page_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(shifted, F.lit("")), F.lit(":"), digest)


def _bounds(sizes: DataFrame, share: int) -> DataFrame:
    """``key`` where each shard but the first begins: keys (``key, bytes``) in order, cut at every ``share`` bytes.

    The running sums are exact: wherever Spark's sample puts the ends of ranges, the shards are the same.
    """
    summed = running(sizes, [], [F.col("key")], {"upto": F.col("bytes")})
    laid = summed.withColumn("shard", F.floor((F.col("upto") - F.col("bytes")) / share))
    return laid.groupBy("shard").agg(F.min("key").alias("key")).where("shard > 0").select("key")


def _with_shard(keyed: DataFrame, bounds: DataFrame, step: int) -> DataFrame:
    """``keyed`` with ``shard``, the number of bounds at or below ``key``.

    They are found among every ``step``-th bound first and then in one block of them.
    """
    listed = F.array_sort(F.collect_list("key"))
    heads, every = bounds.agg(F.filter(listed, lambda k, i: i % step == 0)), bounds.agg(listed)
    rows = keyed.withColumn("heads", heads.scalar()).withColumn("every", every.scalar())
    rows = rows.withColumn("block", F.size(F.filter("heads", lambda h: h <= F.col("key")))).drop("heads")
    rows = rows.withColumn("inside", F.slice("every", F.greatest(F.col("block") - 1, F.lit(0)) * step + 1, F.lit(step))).drop("every")
    within = (F.col("block") - 1) * step + F.size(F.filter("inside", lambda h: h <= F.col("key")))
    return rows.withColumn("shard", F.when(F.col("block") == 0, 0).otherwise(within)).drop("block", "inside")


def write_warc(
    pages: DataFrame, path: str, min_dedup_bytes: int = 0, roll_bytes: int = 32 << 20, shard_bytes: int = 64 << 20, level: int = 4, date: str = EPOCH
) -> DataFrame:
    """Archive ``pages`` (``page_id, url, html``) under ``path`` and return the manifest (``name, shard, bytes``).

    Of equal payloads of at least ``min_dedup_bytes`` bytes the record of the largest ``page_id`` is the response (of
    repeated ids that of the largest url, of repeated rows one), and the others revisit it. The decisions come from
    digests alone. Pages and decisions meet in one range sort by (page_id, digest): a decision precedes its pages, so
    payloads are shuffled once, and a hot id or payload spreads over shards by its digests or ids.

    Shards are cut by bytes, at about ``shard_bytes`` of payload each, or a 200,000th of all where that is more, so
    that their bounds stay a list of some MB. A shard is a task, which holds a few records at a time; it rolls to
    another file at ``roll_bytes`` compressed. All files are written under a temporary name, moved to ``data/`` when
    the job has been committed, and count when the manifest, written last, names them.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", F.upper(F.sha1(body)).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    slim = stage(known.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("n")), "digests")
    best = slim.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("best"))
    decided = slim.withColumnsRenamed({"page_id": "p", "url": "u"}).join(best, ["digest", "size"])
    shared = F.col("size") >= min_dedup_bytes
    lead = F.struct(F.col("p").alias("page_id"), F.col("u").alias("url")).eqNullSafe(F.col("best"))
    decisions = decided.select(
        F.col("p").alias("page_id"), F.col("u").alias("url"), "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"),
        F.when(~shared, "all").when(lead, "first").otherwise("none").alias("responses"), F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"),
    )
    rows = pages.select("page_id", "url", F.upper(F.sha1(body)).alias("digest"), F.lit(1).alias("kind"), body.alias("payload"))
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("responses", "string"), ("best_id", pages.schema["page_id"].dataType), ("best_url", "string"))])
    key = _sort_key(F.col("page_id"), F.col("digest"))
    weight = (F.col("size") + RECORD_BYTES) * F.col("n")
    total = slim.agg(F.sum(weight)).first()[0] or 0
    share = max(shard_bytes, -(-total // MOST_SHARDS))
    shards = max(1, -(-total // share))
    keyed = decisions.unionByName(rows).withColumn("key", key)
    if shards > 1:
        bounds = stage(_bounds(slim.groupBy(key.alias("key")).agg(F.sum(weight).alias("bytes")), share), "bounds")
        keyed = _with_shard(keyed, bounds, max(1, round(shards**0.5)))
    else:
        keyed = keyed.withColumn("shard", F.lit(0))
    placed = keyed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "url", "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = roll = size = repeat = 0
        open_: list[bytes] = []
        files: list[str] = []
        segments: list[bytes] = []
        rule, best = None, None

        def end_segment() -> None:
            nonlocal open_
            segments.append(b"".join(open_)[:-1])
            files.append(f"{shard:06d}-{roll:05d}")
            open_ = []

        def close() -> None:
            nonlocal roll, size
            if open_:
                open_.append(_gzip(_closing(f"{shard:06d}-{roll:05d}", date), level))
                end_segment()
            if size:
                roll, size = roll + 1, 0

        number, held = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    rule, best, repeat = row["responses"], (row["best_id"], row["best_url"]), 0
                    continue
                if row["shard"] != shard:
                    close()
                    shard, roll = row["shard"], 0
                payload = row["payload"]
                response = rule == "all" or rule == "first" and repeat == 0  # repeats of the response revisit it
                member = _gzip(record(row["page_id"], row["url"], payload, _digest(payload), repeat, date, None if response else best), level)
                repeat += 1
                open_.append(member)
                size, held = size + len(member), held + len(member)
                if not member[-1]:
                    end_segment()
                if size >= roll_bytes:
                    close()
                if held > 8 << 20:
                    yield _segments(files, segments, number)
                    number, held, files, segments = number + len(files), 0, [], []
        close()
        yield _segments(files, segments, number)

    temporary, store = f"{path}/_temporary-{uuid.uuid4().hex}", Store(spark, path)
    made = placed.mapInArrow(write, "file string, number long, value binary").sortWithinPartitions("file", "number")
    made.select("file", F.col("value").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(temporary)
    store.make_dir(f"{path}/data")
    files = [(f, next(n for n in store.names(f"{temporary}/{f}") if n.startswith("part-"))) for f in store.names(temporary) if f.startswith("file=")]
    store.move_all([(f"{temporary}/{f}/{n}", f"{path}/data/part-{f.removeprefix('file=')}.warc.gz") for f, n in files])
    store.delete(temporary)
    names = spark.createDataFrame([(f"part-{f.removeprefix('file=')}.warc.gz",) for f, _ in files], "name string")
    held = _files(spark, path).select("name", F.col("length").alias("bytes")).join(names, "name")
    held.select("name", F.split_part("name", F.lit("-"), F.lit(2)).cast("int").alias("shard"), "bytes").write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema("name string, shard int, bytes long").parquet(f"{path}/manifest")


#: What a record's headers weigh, about, when shards are cut.
RECORD_BYTES = 512
MOST_SHARDS = 200_000


def _segments(files: list[str], segments: list[bytes], first: int) -> pa.RecordBatch:
    numbers = pa.array(range(first, first + len(files)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), numbers, pa.array(segments, pa.binary())], names=["file", "number", "value"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and what Spark knows of each file; ``content`` is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(f"{path}/data")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


_READ = [
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
]
_READ_DDL = (
    "file string, offset long, record_type string, page_id long, url string, payload_digest string, payload_bytes long,"
    " refers_to long, payload binary, intact boolean"
)


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    at, fed, step = 0, 0, 1 << 14
    unpacker, parts = zlib.decompressobj(31), []
    while fed < len(data):
        parts.append(unpacker.decompress(data[fed : fed + step]))
        fed = min(fed + step, len(data))
        if unpacker.eof:
            fed -= len(unpacker.unused_data)
            yield at, b"".join(parts)
            at, unpacker, parts = fed, zlib.decompressobj(31), []
    if parts:
        raise ValueError(f"the gzip member at {at} is cut off")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(name: str, at: int, text: bytes) -> dict:
    """One record as a row; ``intact`` says whether its lengths and digests, computed anew, agree with its headers."""
    head, _, rest = text.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    if warc["warc-type"] == "metadata":
        return {"record_type": "metadata"}
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http, revisit = _fields(http_head), warc["warc-type"] == "revisit"
    claimed, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    intact = warc["warc-block-digest"] == f"sha1:{_digest(block)}" and rest[len(block) :] == b"\r\n\r\n"
    found = claimed if revisit else _digest(payload)
    number = lambda k: int(warc[k]) if k in warc else None
    return {
        "file": name, "offset": at, "record_type": warc["warc-type"], "page_id": number("warc-page-id"), "url": warc.get("warc-target-uri"),
        "payload_digest": found, "payload_bytes": size if revisit else len(payload), "refers_to": number("warc-refers-to-page-id"),
        "payload": None if revisit else payload, "intact": intact and found == claimed and (revisit or len(payload) == size),
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest names: where it lies, its headers, payload and ``intact``.

    Each file is a binary row of at most the writer's ``roll_bytes`` and one record more. Digests are computed anew.
    """
    names = spark.read.parquet(f"{path}/manifest").select("name")
    files = _files(spark, path).select("name", "content").join(names, "name", "left_semi")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content")):
                rows = []
                for at, text in members(data.as_py()):
                    row = parse(name, at, text)
                    if row["record_type"] == "metadata":
                        continue
                    rows.append(row if payloads else row | {"payload": None})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema(_READ))

    return files.mapInArrow(unpack, _READ_DDL)


def archive_pages(pages: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a fresh archive, read it back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Edge cases: null html is an empty payload; a null or empty url leaves out its header; repeated rows are records of
    their own, of which one at most is a response; a null ``page_id`` is smaller than
    any other, and a revisit of it refers to null; an empty table makes an archive without files and no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_warc(pages, path, min_dedup_bytes)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
