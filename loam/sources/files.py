"""Sources: source trees, page folders, and the persisted tables, as typed DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loam import schemas
from loam.functions import text as T
from loam.functions.lineage import settle, shared_dir
from loam.sources import store

#: Globs that a scan leaves out unless told otherwise. Fixed values.
EXCLUDE = [
    "**/node_modules/**", "**/.git/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/__pycache__/**",
    "**/*.min.js", "**/*.lock", "**/package-lock.json", "**/poetry.lock", "**/yarn.lock",
]


@F.pandas_udf(StringType())
def _drop_invalid(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def decoded(content: Column | str) -> Column:
    """UTF-8 text with invalid bytes dropped. Valid content, nearly all, is cast in the JVM."""
    body = T.c(content)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(_drop_invalid(body))


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("s3:" + root.removeprefix("s3a:") if root.startswith("s3a:") else root)


def _reachable(root: str) -> bool:
    """Whether Python workers can open the store themselves."""
    try:
        return bool(_store(root))
    except (pa.ArrowInvalid, NotImplementedError, ImportError, OSError):
        return False


def spark_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, content`` by Spark's own reader, for stores that only the Hadoop client knows.

    Its index leaves out empty files and names that begin with ``_`` or ``.``; :func:`unlisted_files` finds those.
    Content is read for the files that are kept alone.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit("^\\Q" + root.rstrip("/") + "\\E/")
    return raw.where("length > 0").select(F.regexp_replace("path", base, F.lit("")).alias("path"), F.col("length").alias("size"), "content")


def _passed_over(path: str) -> bool:
    """Whether Spark's readers leave a file out for a name on its way."""
    return any(p.startswith(".") or p.startswith("_") and "=" not in p or p.endswith("._COPYING_") for p in path.split("/"))


def _in_lots(spark: SparkSession, rows: Iterator[tuple], ddl: str, name: str, lot: int) -> DataFrame:
    """Rows that the driver makes one by one, as a table written ``lot`` rows at a time."""
    path = scratch_dir(spark, name)
    while some := list(islice(rows, lot)):
        spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(path)
    return read_or_empty(spark, path, ddl)


def unlisted_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of the files under ``root`` that Spark's readers pass over, found through the Hadoop client.

    The driver walks the tree and holds 10,000 names at most.
    """
    found = ((path, size) for path, size in store.walk(spark, root) if not size or _passed_over(path))
    return _in_lots(spark, found, "path string, size long", "unlisted", 10_000)


def read_unlisted(files: DataFrame, root: str, lot: int = 64) -> DataFrame:
    """Few and small ``files`` (``path, size``) with their ``content``, read by the driver, ``lot`` at a time."""
    spark, base = files.sparkSession, root.rstrip("/")
    rows = ((r["path"], r["size"], store.content(spark, f"{base}/{r['path']}") if r["size"] else b"") for r in files.select("path", "size").toLocalIterator())
    return _in_lots(spark, rows, "path string, size long, content binary", "read", lot)


_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])


def _lister(root: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = []
                for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=deep)):
                    rows.append({"path": f.path.removeprefix(f"{base}/"), "size": f.size if f.is_file else None, "folder": not f.is_file})
                yield pa.RecordBatch.from_pylist(rows, _LISTED)

    return run


def list_files(spark: SparkSession, root: str, shallow: int = 2) -> DataFrame:
    """``path, size`` of every file under ``root``: the first ``shallow`` levels folder by folder, then a task each folder.

    Spark's own file index leaves out empty files and names that begin with ``_`` or ``.``, such as ``__init__.py``;
    a source tree needs them.
    """
    ddl = "path string, size long, folder boolean"
    level, found = spark.createDataFrame([("",)], "path string"), []
    for _ in range(shallow):
        rows = settle(level.mapInArrow(_lister(root, False), ddl))
        level = rows.where("folder").select("path").repartition("path")
        found.append(rows)
    found.append(level.mapInArrow(_lister(root, True), ddl))
    return reduce(DataFrame.unionAll, found).where("not folder").select("path", "size")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (``path, size``) with the bytes of each as ``content``, null where it cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        base = base.rstrip("/")

        def content(path: str) -> bytes | None:
            try:
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    return stream.read()
            except (FileNotFoundError, PermissionError):
                return None

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = pa.array(map(content, part.column("path").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], names=["path", "size", "content"])

    return files.select("path", "size").mapInArrow(run, "path string, size long, content binary")


def scan_files(
    spark: SparkSession, root: str, include: list[str] = ["**/*"], exclude: list[str] = EXCLUDE, artifact_dirs: list[str] = [],
    max_kb: int = 512, skip_binary: bool = True, max_files: int | None = None,
) -> DataFrame:
    """The files under ``root`` as ``path, lang, size, hash, text, pos``.

    Paths are relative and in the order of their parts. Path and size conditions come before the content is read;
    a NUL in the first 1,024 bytes, or a file that cannot be read, means binary. ``hash`` is of the text with line
    ends made ``\\n``, ``size`` of the raw bytes. A store that Python cannot open is read by Spark, and what Spark's readers
    pass over, empty files and names such as ``__init__.py``, by the driver: the same rows either way.
    """
    def chosen(files: DataFrame) -> DataFrame:
        kept = files.where(F.col("size") <= max_kb * 1024)
        for folder in artifact_dirs:
            kept = kept.where(~F.startswith("path", F.lit(folder.removeprefix("./").rstrip("/") + "/")))
        return kept.where(~F.rlike("path", F.lit(T.glob_regex(exclude)))).where(F.rlike("path", F.lit(T.glob_regex(include))))

    if _reachable(root):
        read = read_contents(chosen(list_files(spark, root)).repartition("path"), root)
    else:
        read = chosen(spark_files(spark, root)).unionByName(read_unlisted(chosen(unlisted_files(spark, root)), root))
    if skip_binary:
        read = read.where(F.col("content").isNotNull() & ~F.rlike(F.hex(F.substring("content", 1, 1024)), F.lit("^(..)*?00")))
    files = read.select("path", T.language("path").alias("lang"), "size", T.normalize_newlines(decoded(F.coalesce("content", F.lit(b"")))).alias("text"))
    return with_positions(files, max_files)


def with_positions(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files with ``hash`` and ``pos``, their place in the order of path parts; the first ``max_files`` only, if set.

    The order is taken over paths alone, one short row a file: sorted in ranges, each numbered from where the ranges
    before it end.
    """
    ranges = files.select("path", F.split("path", "/").alias("parts")).repartitionByRange("parts").sortWithinPartitions("parts")
    # The upper bits of this number are the partition, the lower 33 the row in it.
    rows = settle(ranges.select("path", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a range
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("start"))
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    places = placed.select("path", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("pos"))
    if max_files is not None:
        places = places.where(F.col("pos") < max_files)
    return files.join(places, "path").select("path", "lang", "size", T.content_hash("text").alias("hash"), "text", "pos")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """``documents`` as files ``source/lang/doc_<id>.txt``; ``pos`` is the document's id."""
    path = F.format_string("%s/%s/doc_%d.txt", "source", "lang", "doc_id")
    body = T.normalize_newlines("text")
    return documents.select(
        path.alias("path"), F.lit("text").alias("lang"), F.octet_length("text").cast("long").alias("size"), T.content_hash(body).alias("hash"),
        body.alias("text"), F.col("doc_id").cast("int").alias("pos"),
    )


def scan_pages(spark: SparkSession, root: str, with_roots: bool = True) -> DataFrame:
    """Markdown pages under ``root`` as ``page, text``; proposals are left out, ``index.md`` and ``log.md`` on demand."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    base = (root if "://" in root else f"file:{root}").rstrip("/").replace("file://", "file:")
    pages = raw.select(F.regexp_replace(full, F.lit("^\\Q" + base + "\\E/"), F.lit("")).alias("page"), F.col("value").alias("text"))
    pages = pages.where(~F.endswith("page", F.lit(".proposed.md")))
    return pages if with_roots else pages.where(~F.col("page").isin("index.md", "log.md"))


def read_or_empty(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """A persisted table; a missing one is empty, and broken JSON rows are dropped."""
    try:
        reader = spark.read.schema(ddl).format(fmt)
        return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], ddl)
        raise


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A path in the session's shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def load_snippets(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.SNIPPETS)


def load_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snippets, postings and lengths as :func:`loam.sources.sinks.write_index` wrote them; empty where they are missing."""
    postings = read_or_empty(spark, f"{root}/postings", "term string, field string, cite string, tf long")
    return load_snippets(spark, f"{root}/snippets"), postings, read_or_empty(spark, f"{root}/lengths", "field string, cite string, len int")


def load_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The summary cache; empty where it is missing."""
    return read_or_empty(spark, root, schemas.SUMMARIES)


def load_vectors(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/vectors", schemas.VECTORS)


def load_signature(spark: SparkSession, root: str) -> DataFrame:
    """``signature`` of the stored vectors; no row where there are none."""
    return read_or_empty(spark, f"{root}/signature", "signature string")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash`` of a JSON manifest ``{source_root, files: {path: hash}}``; empty when missing or broken."""
    raw = read_or_empty(spark, path, "source_root string, files map<string,string>", "json")
    return raw.where("files is not null").select(F.explode("files").alias("path", "hash"))


def load_pagemap(spark: SparkSession, path: str) -> DataFrame:
    """A JSON page map in either shape: a list of records, or one object keyed by page."""
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schemas.PAGEMAP)
        raise
    record = "struct<" + schemas.PAGEMAP.replace(" array", ":array").replace(" map", ":map").replace(" string", ":string").replace(" boolean", ":boolean").replace(", ", ",") + ">"
    rest = record.replace("page:string,", "")
    rows = raw.select(F.explode(F.from_json("value", f"array<{record}>")).alias("r")).where("r.page is not null").select("r.*")
    keyed = raw.where(F.startswith(F.trim("value"), F.lit("{"))).select(F.explode(F.from_json("value", f"map<string,{rest}>")).alias("page", "r")).select("page", "r.*")
    out = rows.unionByName(keyed)
    empty = {"source_files": F.array().cast("array<string>"), "source_symbols": F.array().cast("array<string>"), "file_hashes": F.create_map().cast("map<string,string>"), "human_edited": F.lit(False)}
    return out.select("page", *[F.coalesce(k, v).alias(k) for k, v in empty.items()])


def cached_summaries(files: DataFrame, cache: DataFrame, version: int = 2) -> DataFrame:
    """Files with the cached summary of their content as ``cached``, null on a miss or another schema version."""
    hits = cache.where(F.col("schema_version") == version).dropDuplicates(["source_hash"])
    return files.join(hits.select(F.col("source_hash").alias("hash"), F.struct("*").alias("cached")), "hash", "left")


def frontmatter(text: Column | str) -> Column:
    """The block between leading ``---`` lines; empty where there is none. Line ends of either kind."""
    return F.regexp_extract(T.c(text), r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)


def frontmatter_field(text: Column | str, key: str) -> Column:
    """A scalar of the frontmatter, quotes dropped; null where it is missing."""
    found = F.regexp_extract(frontmatter(text), rf"(?m)^{key}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1)
    return F.nullif(found, F.lit(""))


def page_body(text: Column | str) -> Column:
    return F.regexp_replace(T.c(text), r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")


def indexed_pages(index: DataFrame, pages: DataFrame, most: int = 6, chars: int = 3000) -> DataFrame:
    """The first ``most`` pages that ``index`` (``text``) links to and that exist: ``page, text, ord``."""
    linked = index.select(F.posexplode(F.array_distinct(T.links("text"))).alias("ord", "page"))
    found = linked.join(pages, "page").orderBy("ord").limit(most)
    return found.select("page", F.left("text", F.lit(chars)).alias("text"), "ord")
