"""Token counts as delta-maintained rollups: signed changes add up to totals by source, language and tokenizer version.

A rollup is a folder. ``batches/key=<hash of the id>`` holds one batch's signed sums by group and its id, a table that
appears by one rename and never changes; ``snapshots/<n>`` holds the totals of many batches (``totals``) and their ids
(``batches``). Ids are only ever columns, so any string will do, and however many there are, they stay tables.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import Store, fresh_dir, small_batches, stage
from loam.llm.tokens import default_path, word_tokenizer

GROUP = ["source", "lang", "tokenizer"]
#: Tokenizer versions by name: a vocabulary file, or None for runs between ASCII white space.
TOKENIZERS = {"words-1": None, "word_bpe_49k-1": "word_bpe_49k.json"}
_DDL = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizers: dict[str, str | None] = TOKENIZERS) -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` of every row and tokenizer; a null text has 0 tokens."""
    paths = {name: file and (file if "/" in file else default_path(file)) for name, file in tokenizers.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for name, path in paths.items():
                words = lambda t: (t or "").encode("utf-8", "replace").split()
                split = word_tokenizer(path).ids if path else words
                columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
                columns += [pa.array([name] * len(texts), pa.string()), pa.array([len(split(t)) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(count, f"doc_id {kind}, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add the counts of new documents."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take back the counts of deleted documents."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes from the old to the new counts of the same documents, which may also change their group."""
    return deletes(old).unionAll(inserts(new))


def _key(batch: str) -> str:
    """The name of a batch's folder, of hexadecimal digits: readers take names of other letters apart differently."""
    return hashlib.sha256(batch.encode("utf-8", "surrogatepass")).hexdigest()


def commit(spark: SparkSession, root: str, batch: str, changes: DataFrame) -> bool:
    """Add a batch of signed changes once: False, and nothing changes, if ``batch`` was committed before.

    ``batch`` is any string, also an empty one. Only sums by group are written, and a row that bears the id alone, so
    that a batch without changes is known too. The batch counts from the moment its folder is renamed; a run that fails
    before leaves nothing that is read, and of two runs that commit the same batch at once one alone succeeds.
    """
    key = _key(batch)
    store, final = Store(spark, root), f"{root}/batches/key={key}"
    absorbed = _absorbed(spark, root)
    if store.exists(final) or absorbed is not None and not absorbed.where(F.col("key") == key).isEmpty():
        return False
    sums = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    mark = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in GROUP], *[F.lit(0).cast("long").alias(c) for c in ("docs", "tokens")])
    sums.unionAll(mark).withColumn("batch", F.lit(batch)).write.parquet(temporary := f"{root}/temporary/_{uuid.uuid4().hex}")
    return store.publish(temporary, final)


def _snapshot(spark: SparkSession, root: str) -> str | None:
    numbers = [int(n) for n in Store(spark, root).names(f"{root}/snapshots")]
    return f"{root}/snapshots/{max(numbers)}" if numbers else None


def _absorbed(spark: SparkSession, root: str) -> DataFrame | None:
    """``batch, key``: the batches that the newest snapshot holds; a table, however many they are."""
    snapshot = _snapshot(spark, root)
    return spark.read.schema("batch string, key string").parquet(f"{snapshot}/batches") if snapshot else None


def _batches(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the committed batches whose folders are there as this is called, with ``batch`` and ``key``."""
    Store(spark, root).make_dir(f"{root}/batches")
    return spark.read.schema(f"{_DDL}, batch string, key string").parquet(f"{root}/batches")


def _fresh(spark: SparkSession, root: str) -> DataFrame:
    """The rows of committed batches that the newest snapshot lacks."""
    rows, absorbed = _batches(spark, root), _absorbed(spark, root)
    return rows if absorbed is None else rows.join(absorbed, "key", "left_anti")


def _summed(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


def _with_totals(spark: SparkSession, root: str, fresh: DataFrame) -> DataFrame:
    rows, snapshot = fresh.select(*GROUP, "docs", "tokens"), _snapshot(spark, root)
    return _summed(rows.unionAll(spark.read.schema(_DDL).parquet(f"{snapshot}/totals")) if snapshot else rows)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens`` summed over the newest snapshot and the batches after it.

    Groups whose documents and tokens have all been taken back are left out.
    """
    return _with_totals(spark, root, _fresh(spark, root))


def compact(spark: SparkSession, root: str) -> None:
    """Fold all committed batches into a new snapshot, which still knows their ids: replays stay without effect.

    Totals and ids come from one listing of the folders, so a batch is in both or in neither. Folders of batches that
    the snapshot before held are deleted first, one after the other as a join of tables names them; those folded in now
    stay until the next call, for readers that have begun with the old snapshot. One call at a time; commits may go on
    meanwhile.
    """
    store, snapshot, absorbed = Store(spark, root), _snapshot(spark, root), _absorbed(spark, root)
    if absorbed is not None:
        for row in _batches(spark, root).select("key").distinct().join(absorbed, "key", "left_semi").toLocalIterator():
            store.delete(f"{root}/batches/key={row['key']}")
    fresh = _fresh(spark, root)
    temporary = f"{root}/temporary/_{uuid.uuid4().hex}"
    _with_totals(spark, root, fresh).write.parquet(f"{temporary}/totals")
    ids = fresh.select("batch", "key").distinct()
    (ids if absorbed is None else ids.unionAll(absorbed)).write.parquet(f"{temporary}/batches")
    store.publish(temporary, f"{root}/snapshots/{int(snapshot.rpartition('/')[2]) + 1 if snapshot else 0}")


def rollup_documents(docs: DataFrame) -> DataFrame:
    """Totals of a fresh rollup over all ``docs`` after inserts, revised counts, deletes, a snapshot and replays.

    All documents come in under three tokenizer versions, that of the vocabulary with the number of words as its
    provisional count. A second batch revises that to the exact count, and after a snapshot a third deletes the
    version ``words-0``. Each batch is committed once more at the end, without effect.

    Edge cases: a null text counts as a document of 0 tokens; null sources and languages are groups of their own;
    repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    spark, root = docs.sparkSession, fresh_dir(docs.sparkSession, "rollup")
    counts = stage(token_counts(docs), "counts")
    words, exact = counts.where("tokenizer = 'words-1'"), counts.where("tokenizer <> 'words-1'")
    provisional = words.withColumn("tokenizer", F.lit("word_bpe_49k-1"))
    retired = words.withColumn("tokenizer", F.lit("words-0"))
    history = {
        "load": inserts(words.unionAll(provisional).unionAll(retired)),
        "exact": revisions(provisional, exact),
        "retire": deletes(retired),
    }
    for batch, changes in history.items():
        commit(spark, root, batch, changes)
        if batch == "exact":
            compact(spark, root)
    for batch, changes in history.items():
        commit(spark, root, batch, changes)  # a replay, which finds the batch and computes nothing
    return totals(spark, root)
