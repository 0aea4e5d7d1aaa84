"""A search index that takes changes: immutable segments of snippets and postings, and BM25 that stops early.

An update writes one new segment, and names the documents of older segments that it replaces; nothing else is written
again until segments of one size are merged. A version is a short table of the segments and replaced-document tables it
is made of, and readers keep the version they have opened.

Postings lie in blocks of up to 128 documents of one term and field, best first. A block carries the best weight among
its documents, for the average length its segment had and for some larger and smaller ones, since the average moves with
the index; weights grow with it, so that of the next larger average is a bound. A search first reads headers alone, takes
a score to beat from each term's best block, and then reads the blocks that can beat it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam import schemas
from loam.functions.lineage import settle
from loam.operators.search import B, K1, terms
from loam.sources import store

BLOCK = 128
#: The averages, as multiples of the segment's own, for which blocks carry their best weight; past the last, none bounds it but the limit of all weights.
MEANS = [0.8, 0.9, 1.0, 1.05, 1.15, 1.3, 1.6, 2.0, 4.0]
#: Blocks are written in groups of rows of about this size: a search skips those that its terms do not lie in.
ROW_GROUP = 4 << 20
#: A task makes blocks of documents with about this many words, so that its memory does not grow with the index.
RANGE = 2_000_000
#: Blocks that a task hands over at once.
LOT = 10_000
#: Scores this close count as equal while blocks are left out; final scores are compared by six digits or more.
SLACK = 2e-6
#: Features of all questions together up to this number are sent to every task; more are joined.
SMALL = 200_000
#: Postings of a cell of documents and queries, about; a task holds one cell at a time.
CELL = 500_000
#: The feature that marks a document as gone.
GONE = -1
_BODY = ["cite", "pos", "text", "path", "lang", "symbol", "kind", "score"]
_DOCS = schemas.SNIPPETS + ", words array<struct<field:string,terms:array<string>>>, doc bigint, segment int"
_BLOCKS = "term string, field string, n bigint, own double, tops array<double>, entries array<struct<doc:bigint,tf:bigint,len:bigint>>, segment int, block bigint"
_SUMS = "segment int, field string, docs bigint, len bigint"
_GONE = "segment int, doc bigint"
_GONE_TERMS = "segment int, term string, field string, n bigint"


@dataclass
class Index:
    """The tables of one version: ``docs`` and ``blocks`` of its segments, ``gone`` documents, sums that leave those out."""

    version: int
    segments: list[int]
    changes: list[int]
    docs: DataFrame
    blocks: DataFrame
    gone: DataFrame
    gone_terms: DataFrame
    sums: DataFrame

    def snippets(self) -> DataFrame:
        """The live snippets."""
        return self.docs.join(self.gone, ["segment", "doc"], "left_anti").select(*[c.split()[0] for c in schemas.SNIPPETS.split(", ")])

    def stats(self) -> DataFrame:
        """``field, docs, mean`` over live documents."""
        return self.sums.groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("len") / F.sum("docs")).alias("mean")).where("docs > 0")


def _read(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Index:
    """A version of the index under ``root``, the newest one unless told otherwise; an index that is missing is empty."""
    known = [int(n) for n in store.names(spark, f"{root}/versions") if n.isdigit()]
    version = max(known, default=-1) if version is None else version
    rows = spark.read.schema("kind string, number int").parquet(f"{root}/versions/{version}").collect() if version >= 0 else []
    segments = sorted(r["number"] for r in rows if r["kind"] == "segment")
    changes = sorted(r["number"] for r in rows if r["kind"] == "change")
    of = lambda kind, numbers, table: [f"{root}/{kind}/{n}/{table}" for n in numbers]
    live = F.col("segment").isin(segments) if segments else F.lit(False)
    off = _read(spark, of("changes", changes, "sums"), _SUMS).where(live)
    sums = _read(spark, of("segments", segments, "sums"), _SUMS)
    return Index(
        version, segments, changes, _read(spark, of("segments", segments, "docs"), _DOCS), _read(spark, of("segments", segments, "blocks"), _BLOCKS),
        _read(spark, of("changes", changes, "docs"), _GONE).where(live), _read(spark, of("changes", changes, "terms"), _GONE_TERMS).where(live),
        sums.unionAll(off.select("segment", "field", (-F.col("docs")).alias("docs"), (-F.col("len")).alias("len"))),
    )


def _commit(spark: SparkSession, root: str, index: Index, segments: list[int], changes: list[int]) -> None:
    """Publish the version after ``index``; of two writers that began with the same version one alone succeeds."""
    rows = [("segment", n) for n in segments] + [("change", n) for n in changes]
    table = spark.createDataFrame(rows, "kind string, number int").coalesce(1)
    if not store.write_once(table, f"{root}/versions/{index.version + 1}"):
        raise RuntimeError(f"the index {root} has been changed meanwhile: open it again")


def _next(spark: SparkSession, root: str) -> int:
    """A number that no segment or table of changes has, those of failed updates included."""
    taken = [int(n) for kind in ("segments", "changes") for n in store.names(spark, f"{root}/{kind}") if n.isdigit()]
    return max(taken, default=-1) + 1


def _words() -> Column:
    one = lambda name, found: F.struct(F.lit(name).alias("field"), found.alias("terms"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.array(one("body", terms(none("text"))), one("path", F.array_compact(F.array(F.lower("path")))), one("symbol", terms(none("symbol"))))


def _field_sums(docs: DataFrame) -> DataFrame:
    by_field = docs.select("segment", F.explode("words").alias("w")).groupBy("segment", F.col("w.field").alias("field"))
    return by_field.agg(F.count("*").alias("docs"), F.sum(F.size("w.terms")).alias("len"))


def _counted(terms: Column) -> Column:
    """Each distinct term of an array with its count, from the sorted array: what it holds at once is one document's."""
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  # so that a value is computed once, not for each element
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, at: lambda a, k: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).cast("long").alias("tf"))
    return F.when(F.size(terms) > 0, bind(F.sort_array(terms), lambda s: bind(starts(s), lambda at: F.transform(at, run(s, at)))))


def _postings(docs: DataFrame) -> DataFrame:
    """A row for each term of a document's field; a document's words lie in one row, so nothing is shuffled to count them."""
    words = docs.select("doc", F.explode("words").alias("w")).select("doc", "w.field", F.size("w.terms").cast("long").alias("len"), "w.terms")
    each = words.select("doc", "field", "len", F.explode(_counted(F.col("terms"))).alias("t"))
    return each.select("t.term", "field", "doc", "t.tf", "len")


def _cutter(size: int, means: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents (``doc, words``) as its blocks, best first; a block ends with its term or after ``size`` documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: ([], [], []))  # for each field: documents, their lengths, terms
        for batch in batches:
            words = batch.column("words")
            doc = batch.column("doc").to_numpy().repeat(words.value_lengths().fill_null(0).to_numpy())
            fields, lists = words.flatten().flatten()  # a struct's children
            length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            for name in fields.unique().to_pylist():
                here = pc.equal(fields, name).to_numpy(zero_copy_only=False)
                docs, lengths, parts = held[name]
                docs.append(doc[here])
                lengths.append(length[here])
                parts.append(lists.filter(pa.array(here)).flatten().dictionary_encode())
        for name, (docs, lengths, parts) in sorted(held.items()):
            terms = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
            if len(terms):
                yield from _blocks(name, terms, np.concatenate(docs), np.concatenate(lengths), means[name], size)

    return cut


def _blocks(field: str, terms: pa.DictionaryArray, doc: np.ndarray, length: np.ndarray, mean: float, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks in order of terms, of a field's documents with their lengths and, one after another, their terms."""
    known = terms.dictionary
    rank = np.empty(len(known), np.int64)
    rank[pc.array_sort_indices(known).to_numpy()] = np.arange(len(known))
    key = rank[terms.indices.to_numpy()] * len(doc) + np.arange(len(doc)).repeat(length)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf, (term, at) = np.diff(np.r_[first, len(key)]), np.divmod(key[first], len(doc))
    best = np.lexsort((doc[at], -_weight(tf, length[at], mean), term))
    term, at, tf = term[best], at[best], tf[best]
    doc, length, place = doc[at], length[at], np.arange(len(term))
    start = np.maximum.accumulate(np.where(np.r_[True, term[1:] != term[:-1]], place, 0))
    first = np.flatnonzero((place - start) % size == 0)
    ends = np.r_[first, len(term)]
    names = known.take(pc.array_sort_indices(known))
    tops = np.stack([np.maximum.reduceat(_weight(tf, length, mean * m), first) for m in MEANS], 1)
    for low in range(0, len(first), LOT):
        of, cut = slice(low, low + LOT), ends[low : low + LOT + 1]
        n, rows = len(cut) - 1, slice(cut[0], cut[-1])
        entries = pa.StructArray.from_arrays([pa.array(x[rows], pa.int64()) for x in (doc, tf, length)], ["doc", "tf", "len"])
        columns = [names.take(pa.array(term[first[of]])), pa.array([field] * n, pa.string()), pa.array(np.diff(cut), pa.int64()), pa.array(np.full(n, mean))]
        columns += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(MEANS), pa.int32()), pa.array(tops[of].ravel())), pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), entries)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "field", "n", "own", "tops", "entries"])


def _weight(tf, length, mean):
    """What a term's count adds to a score before its rarity, of columns or arrays: grows with the count and the average length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _top(mean: Column) -> Column:
    """The bound of a block's weights under the average ``mean``."""
    kept = [F.when(mean <= F.col("own") * m * (1 + 1e-12), F.get("tops", F.lit(i))) for i, m in enumerate(MEANS)]
    return F.coalesce(*kept, F.lit(K1 + 1))


def _write_segment(spark: SparkSession, root: str, number: int, snippets: DataFrame) -> None:
    """``docs`` (with their words, split once or given), ``sums`` and ``blocks`` of snippets with unique cites.

    Documents are dealt by number over tasks, and each makes blocks of its own share, so that no posting is shuffled.
    """
    path = f"{root}/segments/{number}"
    words = F.col("words") if "words" in snippets.columns else _words()
    docs = snippets.select(*_BODY, words.alias("words"), F.monotonically_increasing_id().alias("doc"), F.lit(number).alias("segment"))
    docs.select(*[c.split()[0] for c in schemas.SNIPPETS.split(", ")], "words", "doc", "segment").write.parquet(f"{path}/docs")
    docs = spark.read.schema(_DOCS).parquet(f"{path}/docs")
    _field_sums(docs).coalesce(1).write.parquet(f"{path}/sums")
    sums = spark.read.schema(_SUMS).parquet(f"{path}/sums")
    means = {r["field"]: r["len"] / r["docs"] for r in sums.collect()}  # a row a field
    n, cores = sums.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0], spark.sparkContext.defaultParallelism
    ranges = docs.select("doc", "words").repartition(max(1, min(cores, n // 20_000), n // RANGE), "doc")
    ddl = _BLOCKS.partition(", segment")[0]
    ranges.mapInArrow(_cutter(BLOCK, means), ddl).select("*", F.lit(number).alias("segment"), F.monotonically_increasing_id().alias("block")).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")


def _latest(snippets: DataFrame) -> DataFrame:
    """Snippets by unique cite; of equal cites the last by position counts."""
    body = [c for c in _BODY if c != "cite"]
    last = snippets.where("cite is not null").groupBy("cite").agg(F.max_by(F.struct(*body), "pos").alias("s"))
    return last.select("cite", "s.*")


def _retire(spark: SparkSession, root: str, index: Index, cites: DataFrame) -> list[int]:
    """Write which live documents bear these cites, and what they take off the counts; the changes of the next version."""
    if not index.segments:
        return index.changes
    live = index.docs.join(index.gone, ["segment", "doc"], "left_anti")
    number = _next(spark, root)
    path = f"{root}/changes/{number}"
    live.select("segment", "doc", "cite").join(cites.select("cite"), "cite", "left_semi").select("segment", "doc").write.parquet(f"{path}/docs")
    gone = spark.read.schema(_GONE).parquet(f"{path}/docs")
    if gone.isEmpty():
        return index.changes
    old = settle(index.docs.join(gone, ["segment", "doc"], "left_semi").select("segment", "doc", "words"))
    words = old.select("segment", "doc", F.explode("words").alias("w")).select("segment", "doc", "w.field", F.explode(F.array_distinct("w.terms")).alias("term"))
    words.groupBy("segment", "term", "field").agg(F.count("*").alias("n")).write.parquet(f"{path}/terms")
    _field_sums(old).coalesce(1).write.parquet(f"{path}/sums")
    return [*index.changes, number]


def upsert(spark: SparkSession, root: str, snippets: DataFrame, merge: bool = True) -> Index:
    """Add snippets (``schemas.SNIPPETS``) to the index under ``root``, or to a new one; a cite that is known is replaced.

    The snippets become a segment of their own. Of older segments only the tables of changes speak: their files stay
    as they are until :func:`merge_tiers` joins segments of one size. Snippets without cite are left out; no snippets
    change nothing.
    """
    index, fresh = open_index(spark, root), settle(_latest(snippets))
    if fresh.isEmpty():
        return index
    number = _next(spark, root)
    _write_segment(spark, root, number, fresh)
    changes = _retire(spark, root, index, fresh)
    _commit(spark, root, index, [*index.segments, number], changes)
    return merge_tiers(spark, root) if merge else open_index(spark, root)


def remove(spark: SparkSession, root: str, cites: DataFrame) -> Index:
    """Take snippets out of the index by ``cite``; unknown ones change nothing."""
    index = open_index(spark, root)
    _commit(spark, root, index, index.segments, _retire(spark, root, index, settle(cites.select("cite").distinct())))
    return open_index(spark, root)


def merge_tiers(spark: SparkSession, root: str, fan: int = 4) -> Index:
    """Join segments where ``fan`` of them have about the same size, or where most of one's documents are gone.

    Sizes are told apart by powers of ``fan``, so a document is rewritten a number of times that grows with the
    logarithm of the index, and other segments are not touched. Tables of changes about joined segments lapse; when
    more than ``fan`` are left, they are joined too.
    """
    index = open_index(spark, root)
    sizes = {r["segment"]: (r["n"], r["whole"]) for r in index.sums.where("field = 'body'").groupBy("segment").agg(F.sum("docs").alias("n"), F.sum(F.greatest("docs", F.lit(0))).alias("whole")).collect()}
    tiers = defaultdict(list)
    for n in index.segments:
        live, whole = sizes.get(n, (0, 0))
        tiers["thin" if 2 * live <= whole else int(log(max(live, 1), fan))].append(n)
    joined = sorted(n for tier, numbers in tiers.items() if tier == "thin" or len(numbers) >= fan for n in numbers)
    if not joined and len(index.changes) <= fan:
        return index
    segments = [n for n in index.segments if n not in joined]
    live = index.docs.where(F.col("segment").isin(joined)).join(index.gone, ["segment", "doc"], "left_anti")
    if joined and not live.isEmpty():
        number = _next(spark, root)
        _write_segment(spark, root, number, live.select(*_BODY, "words"))
        segments.append(number)
    changes = index.changes if segments else []
    if len(changes) > fan:
        number, left = _next(spark, root), F.col("segment").isin(segments)
        path = f"{root}/changes/{number}"
        index.gone.where(left).write.parquet(f"{path}/docs")
        index.gone_terms.where(left).groupBy("segment", "term", "field").agg(F.sum("n").alias("n")).write.parquet(f"{path}/terms")
        off = _read(spark, [f"{root}/changes/{n}/sums" for n in changes], _SUMS).where(left)
        off.groupBy("segment", "field").agg(F.sum("docs").alias("docs"), F.sum("len").alias("len")).write.parquet(f"{path}/sums")
        changes = [number]
    _commit(spark, root, index, segments, changes)
    return open_index(spark, root)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete what none of the last ``keep`` versions reads. No writer may be at work; readers of older versions fail."""
    known = sorted(int(n) for n in store.names(spark, f"{root}/versions") if n.isdigit())
    open_ = [open_index(spark, root, v) for v in known[-keep:]]
    for kind, used in (("segments", {n for i in open_ for n in i.segments}), ("changes", {n for i in open_ for n in i.changes}), ("versions", set(known[-keep:]))):
        for name in store.names(spark, f"{root}/{kind}"):
            if not (name.isdigit() and int(name) in used):
                store.delete(spark, f"{root}/{kind}/{name}")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def top_hits(index: Index, query: DataFrame, k: int | None = 10, every: bool = False, digits: int = 6) -> DataFrame:
    """``query_id, cite, score``: the ``k`` best snippets of each query (``query_id, text``) by BM25 summed over fields.

    Ties, by ``digits`` (six or more) of the score, go to the smaller cite; with ``every``, a snippet must hold all of a query's terms, each in
    any field; without ``k``, all hits come back. A feature is a term in a field, and its bound that of its best block.

    1. Headers of the query's terms give document counts, bounds and each feature's best block. What a query's
       documents reach in those alone is at most their score, so the ``k``-th of these sums is a score to beat.
    2. Features whose bounds together cannot beat it need not be searched: every winner also has one of the others.
       Of those, blocks are read that could beat it if all other features were at their bound.
    3. Postings of those blocks are dealt over tasks by document, and each task adds up every query's scores there. A
       winner's postings are all in such blocks, so its sum is whole; other documents' sums fall short at most.

    With ``every``, the winners are among the documents of the query's rarest term, and steps 1 and 3 fall away: what
    those documents have by then is completed from the other features.

    Edge cases: a query without terms, or whose terms no snippet holds, has no hits; an empty index gives no rows.
    """
    asked = settle(query.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term")))
    wanted = asked.select("term").distinct()
    few = [r["term"] for r in wanted.limit(257).collect()]  # a short list reaches the files' own statistics
    blocks = index.blocks.where(F.col("term").isin(few)) if 0 < len(few) <= 256 else index.blocks
    wanted = _sent(settle(wanted), SMALL if len(few) <= 256 else wanted.count())
    heads = settle(blocks.select("segment", "block", "term", "field", "n", "own", "tops").join(wanted, "term", "left_semi"))
    gone_terms = index.gone_terms.join(wanted, "term", "left_semi").select("term", "field", (-F.col("n")).alias("n"))
    counts = heads.select("term", "field", "n").unionAll(gone_terms).groupBy("term", "field").agg(F.sum("n").alias("df")).where("df > 0")
    stats = F.broadcast(index.stats())  # a row a field
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = counts.join(stats, "field").select("term", "field", "df", "mean", idf.alias("idf"))
    bounds = settle(heads.join(lists, ["term", "field"]).select("segment", "block", "term", "field", (F.col("idf") * _top(F.col("mean"))).alias("bound")))
    best = bounds.groupBy("term", "field").agg(F.max("bound").alias("most"), F.max_by(F.struct("segment", "block"), F.struct("bound", "segment", "block")).alias("at"))
    features = settle(asked.join(lists, "term").join(best, ["term", "field"]))
    size = features.count()

    def hits(of: DataFrame, only: DataFrame) -> DataFrame:
        """``query_id, segment, doc, term, score`` of features in the blocks of ``only``."""
        read = blocks.join(only, ["segment", "block"], "left_semi")
        rows = read.join(_sent(of.select("query_id", "term", "field", "idf", "mean"), size), ["term", "field"])
        rows = rows.select("query_id", "segment", "term", "idf", "mean", F.explode("entries").alias("e"))
        return rows.select("query_id", "segment", "e.doc", "term", (F.col("idf") * _weight(F.col("e.tf"), F.col("e.len"), F.col("mean"))).alias("score"))

    def live(found: DataFrame) -> DataFrame:
        return found.join(index.gone, ["segment", "doc"], "left_anti") if index.changes else found

    doc = ["query_id", "segment", "doc"]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    if every:
        total = Window.partitionBy("query_id", "term")
        rare = features.withColumn("df", F.sum("df").over(total)).groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("rare"))
        split = features.join(rare, "query_id").select("*", (F.col("term") == F.col("rare")).alias("first"), F.lit(0.0).alias("least"), F.lit(0.0).alias("others"), F.lit(0.0).alias("rest"))
    else:
        best_of = features.select("query_id", "term", "field", "idf", "mean", "most", "at.segment", "at.block")
        if k:
            sums = live(hits(features, _sent(best_of.select("segment", "block").distinct(), size)).groupBy(*doc).agg(F.sum("score").alias("score")))
            beat = sums.withColumn("place", place).where(F.col("place") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
            split = features.join(beat, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        else:
            split = features.withColumn("least", F.lit(0.0))
        up = Window.partitionBy("query_id").orderBy("most", "term", "field").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("query_id")
        split = split.withColumn("below", F.sum("most").over(up)).withColumn("first", F.col("below") >= F.col("least"))
        split = split.withColumn("others", F.sum("most").over(whole) - F.col("most")).withColumn("rest", F.coalesce(F.max(F.when(~F.col("first"), F.col("below"))).over(whole), F.lit(0.0)))
    split = settle(split)
    needed = bounds.join(_sent(split.select("term", "field", "others", "least"), size), ["term", "field"]).where("bound + others >= least")
    needed = settle(needed.select("segment", "block").distinct())
    needed = _sent(needed, needed.count())
    if k and not every:
        rows = heads.join(needed, ["segment", "block"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        named = _cells(index, blocks.join(needed, ["segment", "block"], "left_semi"), split, size, rows, k)
        return _ranked(index, named.withColumn("score", F.round("score", digits)), k)
    limits = _sent(split.select("query_id", "least", "rest").distinct(), size)
    found = live(hits(split.where("first"), needed).groupBy(*doc).agg(F.sum("score").alias("score")))
    found = settle(found.join(limits, "query_id").where("score + rest >= least").select(*doc, "score"))
    some = _sent(found.select(*doc), found.count())
    more = hits(split.where("not first"), needed).join(some, doc, "left_semi")
    if every:
        rare = split.where("first").select("query_id", "term").distinct()
        both = found.join(rare, "query_id").select(*doc, "term", "score").unionAll(more.select(*doc, "term", "score"))
        full = both.groupBy(*doc).agg(F.round(F.sum("score"), digits).alias("score"), F.countDistinct("term").alias("held"))
        full = full.join(asked.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id").where("held = wanted").select(*doc, "score")
    else:
        full = found.unionAll(more.select(*doc, "score")).groupBy(*doc).agg(F.round(F.sum("score"), digits).alias("score"))
    return _ranked(index, full, k)


def _ranked(index: Index, full: DataFrame, k: int | None) -> DataFrame:
    """``query_id, cite, score`` of the ``k`` best of each query by score and cite, or of all."""
    if k:
        full = settle(full)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        line = full.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("kth"))
        full = settle(full.join(line, "query_id").where("score >= kth"))
        full = _sent(full, full.count())
    named = index.docs.select("segment", "doc", "cite").join(full, ["segment", "doc"]).select("query_id", "cite", "score")
    if not k:
        return named
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cite")
    return named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _cells(index: Index, blocks: DataFrame, features: DataFrame, size: int, rows: int, k: int) -> DataFrame:
    """``query_id, segment, doc, score``: the best of each share of the documents for each query, all that tie with its last.

    Every winner is among them. A cell is a share of the documents, of about :data:`CELL` postings, and a share of the
    queries, of about :data:`SMALL` features. A posting goes to the cell of its document once for all of a share's queries
    and is added to each query's sums there, so no row is made for each query and document.
    """
    spark, gone = blocks.sparkSession, index.gone.count() if index.changes else 0
    asked = max(1, -(-size // max(1, SMALL)))
    shares = max(1, (rows + gone) // CELL, min(spark.sparkContext.defaultParallelism, rows // 20_000))
    names = settle(features.groupBy("term", "field").agg(F.first("idf").alias("idf"), F.first("mean").alias("mean")).withColumn("feature", F.monotonically_increasing_id()))
    queries = features.select("query_id", "term", "field").join(_sent(names, size), ["term", "field"]).select("query_id", "feature", F.pmod(F.xxhash64("query_id"), F.lit(asked).cast("long")).alias("asked"))
    share = F.pmod(F.xxhash64("segment", "doc"), F.lit(shares).cast("long")).alias("share")
    each = blocks.join(_sent(names, size), ["term", "field"]).select("segment", "feature", "idf", "mean", F.explode("entries").alias("e"))
    each = each.select("segment", "e.doc", "feature", (F.col("idf") * _weight(F.col("e.tf"), F.col("e.len"), F.col("mean"))).alias("score"))
    if index.changes:
        each = each.unionAll(index.gone.select("segment", "doc", F.lit(GONE).cast("long").alias("feature"), F.lit(0.0).alias("score")))
    if asked > 1:
        at = queries.select("feature", "asked").distinct().unionAll(spark.range(asked).select(F.lit(GONE).cast("long").alias("feature"), F.col("id").alias("asked")))
        each = each.join(at, "feature")
    else:
        each = each.withColumn("asked", F.lit(0).cast("long"))
    left = each.select(share, "asked", "segment", "doc", "feature", "score").groupBy("share", "asked")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("of_share"), F.col("asked").alias("of_asked"), "query_id", "feature").groupBy("of_share", "of_asked")
    kind = features.schema["query_id"].dataType.simpleString()
    return left.cogroup(right).applyInArrow(_adder(k), f"query_id {kind}, segment int, doc long, score double")


def _adder(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums of each query's features over the documents of a cell; those that reach its ``k``-th stay."""

    def add(postings: pa.Table, queries: pa.Table) -> pa.Table:
        feature, score = postings.column("feature").to_numpy(), postings.column("score").to_numpy()
        segment, doc = postings.column("segment").to_numpy(), postings.column("doc").to_numpy()
        order = np.lexsort((doc, segment))
        new = np.r_[np.ones(min(1, len(order)), bool), (doc[order][1:] != doc[order][:-1]) | (segment[order][1:] != segment[order][:-1])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]  # a posting of each document
        live = np.ones(len(first), bool)
        live[place[feature == GONE]] = False
        by = np.argsort(feature, kind="stable")
        feature, place, score = feature[by], place[by], score[by]
        asked = queries.column("query_id").combine_chunks().dictionary_encode()
        number, wanted = asked.indices.to_numpy(), queries.column("feature").to_numpy()
        turn = np.lexsort((wanted, number))
        start, stop = np.searchsorted(feature, wanted[turn]), np.searchsorted(feature, wanted[turn], "right")
        ends = np.searchsorted(number[turn], np.arange(len(asked.dictionary) + 1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q in range(len(asked.dictionary)):
            lists = [slice(a, b) for a, b in zip(start[ends[q] : ends[q + 1]], stop[ends[q] : ends[q + 1]]) if a < b]
            if not lists:
                continue
            sums = np.bincount(np.concatenate([place[x] for x in lists]), np.concatenate([score[x] for x in lists]), len(first))
            met = np.flatnonzero((sums > 0) & live)
            if len(met) > k:
                met = met[sums[met] >= np.partition(sums[met], -k)[-k] - SLACK]
            found.append((np.full(len(met), q), met, sums[met]))
        which, at, sums = map(np.concatenate, zip(*found))
        columns = [asked.dictionary.take(pa.array(which)), pa.array(segment[first][at], pa.int32()), pa.array(doc[first][at], pa.int64()), pa.array(sums)]
        return pa.Table.from_arrays(columns, names=["query_id", "segment", "doc", "score"])

    return add
