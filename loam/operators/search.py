"""Search: postings and BM25, substrings, cosine neighbours, rank fusion, and neighbourhood boosts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import settle

#: Words that queries and postings leave out. Fixed values.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not", "of", "on", "or",
    "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your",
]
K1, B = 1.2, 0.75
RRF_K, BOOST, SEEDS = 60, 0.15, 8


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(T.c(text)), F.lit(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def postings(snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(term, field, cite, tf)`` and ``(field, cite, len)`` over body, path and symbol; of equal cites the last counts.

    Terms are taken from the texts once, for both tables and however often they are read.
    """
    fields = F.array(
        F.struct(F.lit("body").alias("field"), terms("text").alias("terms")),
        F.struct(F.lit("path").alias("field"), F.array(F.lower("path")).alias("terms")),
        F.struct(F.lit("symbol").alias("field"), terms("symbol").alias("terms")),
    )
    last = settle(snippets.select("cite", "pos", fields.alias("fields")).groupBy("cite").agg(F.max_by("fields", "pos").alias("fields")))
    split = last.select("cite", F.explode("fields").alias("f")).select("cite", "f.field", "f.terms")
    lengths = split.select("field", "cite", F.size("terms").alias("len"))
    found = split.select("field", "cite", F.explode("terms").alias("term")).groupBy("term", "field", "cite").agg(F.count("*").alias("tf"))
    return found, lengths


def bm25(found: DataFrame, lengths: DataFrame, query: DataFrame, every: bool = True) -> DataFrame:
    """``query_id, cite, score`` of the BM25 score summed over fields and terms.

    ``query`` is ``query_id, text``; only postings of its terms are read: the semi join on the term goes below the
    postings' own aggregation. With ``every``, a snippet must hold all of a query's terms, each in any field.
    """
    asked = query.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))
    found = settle(found.join(asked.select("term").distinct(), "term", "left_semi"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    hits = found.join(asked, "term")
    seen = found.groupBy("term", "field").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = hits.join(seen, ["term", "field"]).join(stats, "field").join(lengths, ["field", "cite"])
    sums = scored.groupBy("query_id", "cite").agg(F.sum(idf * tf).alias("score"), F.countDistinct("term").alias("held"))
    if not every:
        return sums.select("query_id", "cite", "score")
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    return sums.join(wanted, "query_id").where("held = wanted").select("query_id", "cite", "score")


def substring_hits(snippets: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """Snippets by how often their text holds the whole query, case ignored, without overlaps; ties by position."""
    if not query.strip():
        return snippets.limit(0)
    count = F.regexp_count(F.lower("text"), F.lit("\\Q" + query.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"))
    hits = snippets.withColumn("score", count.cast("double")).where("score > 0").orderBy(F.desc("score"), "pos", "cite")
    return hits.limit(k) if k else hits


def cosine(a: Column, b: Column) -> Column:
    """In double precision over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.transform(F.slice(x, F.lit(1), n), lambda v: v.cast("double")) for x in (a, b))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v)))
    return F.when(norm == 0, 0.0).otherwise(total(F.zip_with(a, b, lambda x, y: x * y)) / norm)


def vector_hits(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``cite, score`` of the ``k`` vectors of largest cosine with ``query``; exact, one scan, ties by cite.

    Scores are rounded to 9 digits, so that ties do not hang on the order of sums.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("cite", F.round(cosine(F.col("embedding"), asked), 9).alias("score")).orderBy(F.desc("score"), "cite").limit(k)


def embed_snippets(snippets: DataFrame, embed: Callable, chars: int = 4000) -> DataFrame:
    """``cite, embedding`` by an injected pandas UDF over the first ``chars`` characters; of equal cites the last counts."""
    last = snippets.groupBy("cite").agg(F.max_by("text", "pos").alias("text"))
    return last.select("cite", embed(F.left("text", F.lit(chars))).alias("embedding"))


def snippet_signature(snippets: DataFrame, model: str) -> DataFrame:
    """``signature`` of a snippet set for a model: stored vectors with another signature are stale.

    It hashes the number of snippets and the sums of two 60-bit halves of their hashes, so nothing is gathered and the
    order of snippets does not matter.
    """
    one = F.sha2(F.concat("cite", F.lit("|"), F.sha2("text", 256)), 256)
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring(one, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    parts = F.concat_ws(":", F.count("*").cast("string"), half(1), half(16))
    return snippets.agg(F.sha2(F.concat(F.lit(model + "\n"), parts), 256).alias("signature"))


def fresh_vectors(snippets: DataFrame, embed: Callable, model: str, root: str) -> DataFrame:
    """The vectors stored under ``root`` if their signature is that of ``snippets`` and ``model``, else new ones, stored."""
    from loam.sources import files, sinks

    spark, wanted = snippets.sparkSession, snippet_signature(snippets, model)
    stored = files.load_signature(spark, root)
    if stored.join(wanted, "signature", "left_semi").isEmpty():
        sinks.write_vectors(embed_snippets(snippets, embed), root, wanted)
    return files.load_vectors(spark, root)


def candidate_depth(k: int) -> int:
    return max(12, 3 * k)


def fuse_ranks(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(cite, rank)`` lists: ``cite, score, seq``; earlier lists and ranks win ties."""
    rows = [x.select("cite", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    fused = both.groupBy("cite").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seq"))
    return fused.orderBy(F.desc("score"), "seq").limit(k) if k else fused


def ranked(hits: DataFrame, *order: Column | str) -> DataFrame:
    """``cite, rank`` from 1; the rows are a candidate list, already cut to its depth."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("cite", "rank")


def _boosted(fused: DataFrame, corpus: DataFrame, paths: DataFrame) -> DataFrame:
    """``fused`` with the boost added once for each corpus row of a cite in these paths."""
    times = corpus.join(fused.select("cite"), "cite", "left_semi").join(paths, "path", "left_semi").groupBy("cite").agg(F.count("*").alias("times"))
    return fused.join(times, "cite", "left").withColumn("score", F.col("score") + BOOST * F.coalesce("times", F.lit(0))).drop("times")


def boost_by_graph(fused: DataFrame, corpus: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Boost what lies in the seeds' files or files they point to (``edges``: file and symbol nodes)."""
    paths = seeds.where("path <> ''").select("path").distinct()
    out = edges.join(paths.select(F.concat(F.lit("file:"), "path").alias("src")), "src", "left_semi").where(F.startswith("dst", F.lit("file:")))
    reached = out.select(F.substring("dst", 6, 10_000).alias("path"))
    return _boosted(fused, corpus, paths.union(reached).distinct())


def boost_by_symbols(fused: DataFrame, corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """Boost files that share a symbol with the seeds, and files that share one with those."""
    held = corpus.where("path <> '' and symbol <> ''").select("path", "symbol").distinct()
    near = seeds.where("path <> ''").select("path").union(held.join(seeds.select("symbol").distinct(), "symbol", "left_semi").select("path")).distinct()
    shared = held.join(near, "path", "left_semi").select("symbol").distinct()
    return _boosted(fused, corpus, near.union(held.join(shared, "symbol", "left_semi").select("path")).distinct())


def retrieve(
    snippets: DataFrame, found: DataFrame | None, lengths: DataFrame | None, question: str, k: int = 8, vectors: DataFrame | None = None,
    query_vector: list[float] | None = None, edges: DataFrame | None = None, every: bool = False,
    bm25_payload: DataFrame | None = None, vector_payload: DataFrame | None = None, lexical: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best snippets for a question: BM25 and, given vectors, cosine lists fused by rank, then boosted.

    The seeds are the first hits of BM25. Boosts follow graph edges where there are any, else shared symbols. Every
    list is cut to its depth before ranking, so the windows run over a few dozen rows. Where the BM25 index or the
    vector store keep snippets of their own (tables like ``snippets``), a hit's text is the vector store's, else the
    index's, else that of ``snippets``. Scores are rounded to 9 digits before ranking. ``lexical`` gives BM25 hits
    (``cite, score``) that a stored index has found, in place of postings and lengths.
    """
    depth = candidate_depth(k)
    ask = snippets.sparkSession.createDataFrame([(0, question)], "query_id int, text string")
    best = (bm25(found, lengths, ask, every) if lexical is None else lexical).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "cite").limit(depth)
    lists = [settle(ranked(best, F.desc("score"), "cite"))]
    if vectors is not None and query_vector is not None:
        lists.append(settle(ranked(vector_hits(vectors, query_vector, depth), F.desc("score"), "cite")))
    fused = fuse_ranks(lists)
    seeds = snippets.join(lists[0].where(F.col("rank") <= SEEDS).select("cite"), "cite", "left_semi").select("path", "symbol")
    scored = boost_by_graph(fused, snippets, seeds, edges) if edges is not None else boost_by_symbols(fused, snippets, seeds)
    top = settle(scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "seq").limit(k))
    body = ["text", "path", "lang", "symbol", "kind"]
    stores = [snippets, *[p.join(x.select("cite"), "cite", "left_semi") for p, x in zip((bm25_payload, vector_payload), lists) if p is not None]]
    told = reduce(DataFrame.unionAll, [s.join(top.select("cite"), "cite", "left_semi").select("cite", F.struct(F.lit(i).alias("store"), "pos").alias("at"), *body) for i, s in enumerate(stores)])
    payload = told.groupBy("cite").agg(F.max_by(F.struct(*body), "at").alias("s"))
    return top.join(payload, "cite").select("cite", "score", "s.*").orderBy(F.desc("score"), "cite")


def answer_evidence(top: DataFrame) -> DataFrame:
    """``line``: the offline answer, a line of preview for each snippet found."""
    return top.select(F.concat(F.lit("- "), "cite", F.lit(": "), T.preview("text")).alias("line"))


def chat_prompt(question: str, top: DataFrame, pages: DataFrame) -> DataFrame:
    """``prompt`` with 8 snippets of 700 characters and 6 pages of 600 at most."""
    shown = F.array_sort(F.collect_list(F.struct(-F.col("score"), "cite", F.left("text", F.lit(700)).alias("text"))))
    evidence = top.agg(F.array_join(F.transform(F.slice(shown, F.lit(1), F.lit(8)), lambda s: F.concat(F.lit("["), s["cite"], F.lit("]\n"), s["text"])), "\n\n").alias("e"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "page", F.left("text", F.lit(600)).alias("text"))))
    context = pages.agg(F.array_join(F.transform(F.slice(listed, F.lit(1), F.lit(6)), lambda p: F.concat(F.lit("# "), p["page"], F.lit("\n"), p["text"])), "\n\n").alias("p"))
    return evidence.select(F.concat(F.lit("Question: " + question + "\n\nEvidence:\n"), "e", F.lit("\n\nPages:\n"), context.scalar()).alias("prompt"))
