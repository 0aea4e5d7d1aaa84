"""Queries over documents, embeddings, conversations and events: text functions, search, manifests, logs."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import settle, shared_dir
from loam.operators import chunks, incremental, repomap, search, segments, spans, summarize
from loam.plans import synth
from loam.plans.base import Register
from loam.plans.synth import table
from loam.sources import files as sources
from loam.sources import sinks, store

query = Register()
QUERIES, SQL = query.queries, query.sql

DOC_PATH = "source || '/' || lang || '/doc_' || doc_id || '.txt'"
#: Lines of a document as Python's splitlines() gives them.
LINES_SQL = r"regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
_LINES = f"""lines as (select doc_id, source, lang, case when text = '' then [] when right(t, 1) = chr(10) then string_split(left(t, length(t) - 1), chr(10)) else string_split(t, chr(10)) end as l
  from (select doc_id, source, lang, text, {LINES_SQL} as t from documents))"""
_CHUNKS = _LINES + f""", chunks as (select {DOC_PATH} as path, lang, a as beg, least(a + 120, len(l)) as stop, array_to_string(l[a + 1 : a + 120], chr(10)) as text, doc_id
  from (select *, unnest(range(0, len(l), 120)) as a from lines where len(l) > 0))"""
_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents_as_files(table(spark, sf_dir, "documents"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_lines(documents(spark, sf_dir))


def stored_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """The index of the documents' snippets, built when the session first asks for it and read by its later queries.

    It lies in the shared folder under the signature of the documents' files, so changed files get an index of their own.
    """
    root = f"{shared_dir(spark)}/index-{store.file_signature(table(spark, sf_dir, 'documents'))}"
    index = segments.open_index(spark, root)
    return index if index.version >= 0 else segments.upsert(spark, root, snippets(spark, sf_dir))


@query(f"with {_CHUNKS} select path, path || ':L' || (beg + 1) || '-L' || stop as cite, sha256(text) as hash, length(text) as n from chunks")
def chunk_lines(spark, sf_dir):
    return snippets(spark, sf_dir).select("path", "cite", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("n"))


@query(f"""with {_CHUNKS}, hits as (select path || ':L' || (beg + 1) || '-L' || stop as cite, (length(lower(text)) - length(replace(lower(text), 'queue', ''))) / 5.0 as score from chunks)
select cite, cast(score as double) as score from hits where score > 0""")
def search_substring(spark, sf_dir):
    return search.substring_hits(snippets(spark, sf_dir), "queue").select("cite", "score")


@query(f"""with {_CHUNKS}, hits as (select path || ':L' || (beg + 1) || '-L' || stop as cite, (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3.0 as score, doc_id, beg from chunks)
select cite, cast(score as double) as score from hits where score > 0 order by score desc, doc_id, beg, cite limit 10""")
def search_topk(spark, sf_dir):
    return search.substring_hits(snippets(spark, sf_dir), "the", 10).select("cite", "score")  # one scan: no index is asked for


@query("select lang, count(*) as n from documents group by lang")
def lang_stats(spark, sf_dir):
    return repomap.language_stats(table(spark, sf_dir, "documents"))


@query("select source as component, count(*) as n from documents group by source order by n desc, min(doc_id) limit 12")
def top_components(spark, sf_dir):
    return repomap.top_components(documents(spark, sf_dir))


@query("select source as component, count(*) as n from documents group by source order by n desc, min(doc_id) limit 5")
def onboarding_components(spark, sf_dir):
    return repomap.top_components(documents(spark, sf_dir), 5)


@query(f"select {DOC_PATH} as path, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) as hash from documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("path", "hash")


@query(f"select doc_id, cast(floor(len({_WORDS}) * 1.35::double) as int) as tokens from documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query(f"""select conv_id, sum(cast(floor(len(list_filter(regexp_split_to_array(role || chr(10) || text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')) * 1.35::double) as int))::bigint as tokens
from conversations group by conv_id""")
def conversation_tokens(spark, sf_dir):
    tokens = T.token_estimate(F.concat("role", F.lit("\n"), "text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tokens).alias("tokens"))


@query(f"select doc_id, left(array_to_string({_WORDS}, ' '), 240) as preview from documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"))


@query(r"""select p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(p_name || '  /' || p_type || '!')), '[^\p{L}\p{N} \-_/.]', '', 'g'), '[ \-_/.]+', '-', 'g'), '-'), ''), 'page') as slug from part""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit("  /"), "p_type", F.lit("!"))).alias("slug"))


@query("select l_orderkey, l_linenumber, 'o/' || l_orderkey || '.py:L' || l_linenumber || '-L' || (l_linenumber + cast(l_quantity as int)) as cite from lineitem")
def cite_render(spark, sf_dir):
    end = F.col("l_linenumber") + F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.cite(F.concat(F.lit("o/"), "l_orderkey", F.lit(".py")), "l_linenumber", end).alias("cite"))


@query("select l_orderkey, 'o/' || l_orderkey || '.py' as path, l_linenumber as start, l_linenumber + cast(l_quantity as int) as stop from lineitem")
def cite_parse(spark, sf_dir):
    span = T.cite_span("cite")
    return cite_render(spark, sf_dir).select("l_orderkey", T.cite_path("cite").alias("path"), span["start"].alias("start"), span["end"].alias("stop"))


_TERMS = r"""list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+(?:\.[\p{{L}}\p{{N}}_]+)*'), lambda w: length(w) > 1 and w not in ('""" + "','".join(search.STOP_WORDS) + "'))"
_BM25 = _CHUNKS + f""", s as (select path || ':L' || (beg + 1) || '-L' || stop as cite, path, text from chunks),
fields as (select cite, 'body' as field, {_TERMS.format(x='text')} as t from s union all select cite, 'path', [lower(path)] from s union all select cite, 'symbol', [] from s),
lens as (select cite, field, len(t) as len from fields), stats as (select field, count(*) as docs, avg(len) as mean from lens group by field),
post as (select cite, field, term, count(*) as tf from (select cite, field, unnest(t) as term from fields) group by all),
q as (select item_id as query_id, unnest(list_distinct({_TERMS.format(x='text')})) as term from benchmark),
hits as (select * from post join q using (term)), df as (select term, field, count(distinct cite) as df from hits group by all),
scored as (select query_id, cite, term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as x from hits join df using (term, field) join stats using (field) join lens using (cite, field)),
sums as (select query_id, cite, sum(x) as score, count(distinct term) as held from scored group by all), wanted as (select query_id, count(*) as wanted from q group by all)"""


@query(f"with {_BM25} select field, term, count(*) as df, sum(tf)::bigint as n from post group by all")
def index_terms(spark, sf_dir):
    """Builds the stored index, unless it is there: its terms, documents and occurrences by field."""
    rows = stored_index(spark, sf_dir).blocks.select("field", "term", F.col("n").alias("df"), F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["tf"]).alias("n"))
    return rows.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"with {_BM25} select query_id, cite, round(score, 6) as score from sums join wanted using (query_id) where held = wanted")
def bm25_all_terms(spark, sf_dir):
    return segments.top_hits(stored_index(spark, sf_dir), _asked(spark, sf_dir), None, every=True)


_TOP = "select query_id, cite, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 6) desc, cite) as r from sums) where r <= 10"


@query(f"with {_BM25} {_TOP}")
def bm25_topk(spark, sf_dir):
    return segments.top_hits(stored_index(spark, sf_dir), _asked(spark, sf_dir))


def _changed(base: str) -> str:
    """SQL: what the snippets are after both updates and the removals of :func:`index_update`."""
    cut = base.index("fields as (")
    last = """s0 as (select path || ':L' || (beg + 1) || '-L' || stop as cite, path, text, doc_id from chunks),
s as (select cite, path, case when doc_id % 3 = 1 then text || chr(10) || 'renewed passage ' || doc_id when doc_id % 3 = 2 then 'second edition ' || text else text end as text from s0 where doc_id % 10 <> 7),
"""
    return base[: base.index("s as (select path")] + last + base[cut:]


@query(f"with {_changed(_BM25)} {_TOP}")
def index_update(spark, sf_dir):
    """Search after an index has taken a third of all snippets anew, then another third, and lost those of some documents."""
    root, rows = sources.scratch_dir(spark, "index"), snippets(spark, sf_dir)
    doc = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    segments.upsert(spark, root, rows)
    segments.upsert(spark, root, rows.where(doc % 3 == 1).withColumn("text", F.concat("text", F.lit("\nrenewed passage "), doc)))
    segments.upsert(spark, root, rows.where(doc % 3 == 2).withColumn("text", F.concat(F.lit("second edition "), "text")))
    return segments.top_hits(segments.remove(spark, root, rows.where(doc % 10 == 7)), _asked(spark, sf_dir))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("vec_%07d", "vec_id").alias("cite"), "embedding", "vec_id")


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_COS = """v as (select vec_id, 'vec_' || lpad(vec_id::varchar, 7, '0') as cite, list_transform(embedding, lambda x: x::double) as e from embeddings),
cos as (select v.cite, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) as score from v, (select e from v where vec_id = 0) q)"""


@query(f"with {_COS} select cite, score from cos order by score desc, cite limit 24")
def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    return v.select("cite", F.round(search.cosine(F.col("embedding"), asked), 6).alias("score")).orderBy(F.desc("score"), "cite").limit(24)


_RRF = _COS + f""", {_CHUNKS}, sub as (select doc_id, max((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3.0) as n from chunks group by doc_id),
a as (select doc_id as id, row_number() over (order by n desc, doc_id) as rank from sub where n > 0 qualify rank <= 24),
b as (select vec_id as id, row_number() over (order by score desc, cite) as rank from cos qualify rank <= 24),
fused as (select id, sum(1.0 / (60 + rank)) as score, min([l, rank]) as seq from (select id, rank, 0 as l from a union all select id, rank, 1 from b) group by id)"""


def _lists(spark, sf_dir):
    hits = search.substring_hits(snippets(spark, sf_dir), "the")
    docs = hits.groupBy(F.regexp_extract("path", r"doc_(\d+)", 1).cast("long").alias("id")).agg(F.max("score").alias("n"))
    a = settle(docs.orderBy(F.desc("n"), "id").limit(24))
    a = a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id"))).select(F.col("id").alias("cite"), "rank")
    b = settle(vector_topk(spark, sf_dir))
    b = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "cite"))).select(F.substring("cite", 5, 10).cast("long").alias("cite"), "rank")
    return a, b


@query(f"with {_RRF} select id, round(score, 9) as score from fused order by fused.score desc, seq limit 24")
def rrf_fuse(spark, sf_dir):
    return search.fuse_ranks(list(_lists(spark, sf_dir)), 24).select(F.col("cite").alias("id"), F.round("score", 9).alias("score"))


_CORPUS = "corpus as (select doc_id as cite, source as path, lang || '_' || (doc_id % 40) as symbol from documents)"


def _corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("cite"), F.col("source").alias("path"), F.concat("lang", F.lit("_"), F.col("doc_id") % 40).alias("symbol"))


@query(f"""with {_RRF}, {_CORPUS}, seeds as (select * from corpus join a on cite = id where rank <= 3),
near as (select path from seeds union select path from corpus where symbol in (select symbol from seeds)),
shared as (select symbol from corpus where path in (select path from near)), paths as (select path from near union select path from corpus where symbol in (select symbol from shared))
select id, round(score + case when path in (select path from paths) then 0.15 else 0 end, 9) as score from fused join corpus on id = cite""")
def hybrid_metadata_boost(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    corpus = _corpus(spark, sf_dir)
    seeds = corpus.join(a.where("rank <= 3").select("cite"), "cite", "left_semi")
    fused = search.fuse_ranks([a, b]).join(corpus.select("cite"), "cite", "left_semi")
    return search.boost_by_symbols(fused, corpus, seeds).select(F.col("cite").alias("id"), F.round("score", 9).alias("score"))


@query(f"""with {_RRF}, {_CORPUS}, seeds as (select * from corpus join a on cite = id where rank <= 8),
paths as (select path from seeds union select 'src' || ((replace(path, 'src', '')::int * 3 + 1) % 20) from seeds)
select id, round(score + case when path in (select path from paths) then 0.15 else 0 end, 9) as score from fused join corpus on id = cite""")
def hybrid_graph_boost(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    corpus = _corpus(spark, sf_dir)
    seeds = corpus.join(a.where("rank <= 8").select("cite"), "cite", "left_semi")
    fused = search.fuse_ranks([a, b]).join(corpus.select("cite"), "cite", "left_semi")
    paths = corpus.select("path").distinct()
    to = (F.replace("path", F.lit("src"), F.lit("")).cast("int") * 3 + 1) % 20
    edges = paths.select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("file:src"), to).alias("dst"))
    return search.boost_by_graph(fused, corpus, seeds, edges).select(F.col("cite").alias("id"), F.round("score", 9).alias("score"))


_ASKED = "the tion of reading"
_HYBRID = _BM25.replace("select item_id as query_id", "select 0 as query_id").replace("from benchmark)", f"from (select '{_ASKED}' as text))") + """,
ve as (select path, cite, list_transform(embedding, lambda x: x::double) as e from embeddings join (select doc_id, path, path || ':L1-L' || stop as cite from chunks where beg = 0) on doc_id = vec_id),
qv as (select list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id = 0),
la as (select cite, row_number() over (order by round(score, 9) desc, cite) as rank from sums qualify rank <= 24),
lb as (select cite, row_number() over (order by round(list_cosine_similarity(ve.e, qv.e), 9) desc, cite) as rank from ve, qv qualify rank <= 24),
fused as (select cite, sum(1.0::double / (60 + rank)) as score, min([l, rank]) as seq from (select cite, rank, 0 as l from la union all select cite, rank, 1 from lb) group by cite),
near as (select distinct path from s join la using (cite) where rank <= 8),
top as (select cite, round(score + case when path in (select path from near) then 0.15 else 0 end, 9) as score, path, seq from fused join s using (cite))"""


@query(f"with {_HYBRID} select cite, round(score, 6) as score, path from top order by top.score desc, seq limit 8")
def retrieve_hybrid(spark, sf_dir):
    """BM25 over the stored index and cosine over stored vectors of documents' first snippets, fused and boosted."""
    index = stored_index(spark, sf_dir)
    stored = index.snippets()
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc"), "embedding")
    first = stored.where(F.contains("cite", F.lit(":L1-L"))).select("cite", F.regexp_extract("path", r"doc_(\d+)", 1).alias("doc"))
    vectors = first.join(e, "doc").select("cite", "embedding")
    ask = spark.createDataFrame([(0, _ASKED)], "query_id int, text string")
    best = segments.top_hits(index, ask, search.candidate_depth(8), digits=9)
    top = search.retrieve(stored, None, None, _ASKED, 8, vectors, _query_vector(spark, sf_dir), lexical=best)
    return top.select("cite", F.round("score", 6).alias("score"), "path")


@query("""with h as (select sha256(doc_id || '|' || sha256(text)) as h from documents)
select sha256('m' || chr(10) || count(*) || ':' || sum(('0x' || substr(h, 1, 15))::bigint) || ':' || sum(('0x' || substr(h, 16, 15))::bigint)) as signature from h""")
def vector_signature(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("cite"), "text")
    return search.snippet_signature(d, "m")


@query(f"with {synth.DIFF_SQL} select path, change from diff")
def manifest_diff(spark, sf_dir):
    return incremental.manifest_diff(*synth.snapshots(spark, sf_dir))


_PAGEMAP = "map as (select 'components/g' || (doc_id // 3) || '.md' as page, doc_id, (doc_id // 3) % 5 = 0 as locked from documents)"


@query(f"with {synth.DIFF_SQL}, {_PAGEMAP} select distinct page from map join diff using (doc_id)")
def affected_pages(spark, sf_dir):
    return incremental.affected_pages(synth.pagemap(spark, sf_dir), manifest_diff(spark, sf_dir))


@query(f"with {synth.DIFF_SQL}, {_PAGEMAP} select distinct page, case when locked then 'propose' else 'regenerate' end as action from map join diff using (doc_id)")
def refresh_plan(spark, sf_dir):
    locked = synth.pagemap(spark, sf_dir).where("human_edited").select("page")
    return incremental.plan_refresh(affected_pages(spark, sf_dir), locked)


def _doc_signals(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["api_route", "integration", "config"])), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf_dir, "documents")
    cite = F.format_string("%s/%s/doc_%d.txt:L1-L1", "source", "lang", "doc_id")
    return d.select(kind.alias("type"), F.format_string("GET /cap_%d/x", F.col("doc_id") % 10).alias("name"), cite.alias("cite")).groupBy("type", "name").agg(F.collect_set("cite").alias("evidence"))


@query(f"""with {synth.DIFF_SQL}, sig as (select diff.*, doc_id % 3 as kind from diff where change <> 'removed')
select distinct 'components/' || split_part(path, '/', 1) || '.md' as page from diff union select 'capabilities/cap-' || doc_id % 10 || '.md' from sig where kind = 0
union select 'domain/glossary.md' from sig where kind in (1, 2) union select 'integrations/external-systems.md' from sig where kind = 1
union select unnest(['00-overview/tech-stack.md', '00-overview/component-graph.md', '00-overview/executive-summary.md']) from diff where change <> 'changed'""")
def predict_pages(spark, sf_dir):
    return incremental.predicted_pages(manifest_diff(spark, sf_dir), _doc_signals(spark, sf_dir))


@query(f"""with {synth.DIFF_SQL}, {_PAGEMAP}, p as (select distinct page, case when locked then 'proposed_pages' else 'regenerated_pages' end as item from map join diff using (doc_id))
select change as item, string_agg(path, ';' order by path) as names from diff group by change union all select item, string_agg(page, ';' order by page) from p group by item
union all select 'affected_pages', string_agg(page, ';' order by page) from p""")
def update_report(spark, sf_dir):
    none = affected_pages(spark, sf_dir).limit(0)
    report = incremental.update_report(manifest_diff(spark, sf_dir), affected_pages(spark, sf_dir), refresh_plan(spark, sf_dir), none, none)
    return report.select("item", F.array_join("names", ";").alias("names"))


def _group_pages(manifest: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A page for each group of three documents with the number of its files and the least hash among them."""
    id_ = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    rows = manifest.select(F.format_string("components/g%d.md", (id_ / 3).cast("long")).alias("page"), "hash")
    rows = rows.join(wanted, "page", "left_semi") if wanted is not None else rows
    text = F.concat(F.lit("---\ntitle: G\n---\n\n## Summary\n"), F.count("*"), F.lit(" files\n\n## Files\n"), F.min("hash"), F.lit("\n"))
    return rows.groupBy("page").agg(text.alias("text"))


def _page_text(n: str, h: str, mark: str = "") -> str:
    return f"'---' || chr(10) || 'title: G' || chr(10) || {mark or chr(39) * 2} || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || {n} || ' files' || chr(10) || chr(10) || '## Files' || chr(10) || {h} || chr(10)"


@query(f"""with {synth.DIFF_SQL}, {_PAGEMAP}, d as (select doc_id, 'components/g' || (doc_id // 3) || '.md' as page, (doc_id // 3) % 5 = 0 as locked, text from documents),
was as (select page, count(*) as n, min(sha256(text)) as h from d where doc_id % 19 <> 0 group by page),
now as (select page, any_value(locked) as locked, count(*) as n, min(sha256(case when doc_id % 13 = 0 then text || '!' else text end)) as h from d where doc_id % 17 <> 0 group by page),
hit as (select distinct page from map join diff using (doc_id)),
fresh as (select now.*, was.n as before from now join hit using (page) left join was using (page)),
out as (select page, {_page_text('n', 'h')} as text from was where page not in (select page from hit)
  union all select page, {_page_text('n', 'h')} from was where page in (select page from hit) and page in (select page from map where locked)
  union all select replace(page, '.md', '.proposed.md'), {_page_text('n', 'h')} from fresh where locked
  union all select page, {_page_text('n', 'h', "case when before <> n then 'contradiction: true' || chr(10) else '' end")} from fresh where not locked)
select page, sha256(text) as hash from out""")
def update_pages(spark, sf_dir):
    """The page table after an update, from two manifests of documents."""
    old, new = synth.snapshots(spark, sf_dir)
    done = incremental.update_pages(old, new, synth.pagemap(spark, sf_dir), _group_pages(old), _doc_signals(spark, sf_dir), lambda wanted: _group_pages(new, wanted))
    return done.pages.select("page", F.sha2("text", 256).alias("hash"))


@query(r"""with parts as (select conv_id, string_agg(role || ': ' || left(array_to_string(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> ''), ' '), 240), chr(10) order by turn) as context
from conversations group by conv_id) select conv_id, context from parts""")
def chat_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), T.preview("text")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


@query("""select count(*) as requests, sum(event_id % 100)::bigint as prompt_tokens, sum(user_id % 7)::bigint as completion_tokens, sum(event_id % 100 + user_id % 7)::bigint as total_tokens,
sum(event_id % 100 + user_id % 7) > 100000 as exceeded from events""")
def budget_usage(spark, sf_dir):
    usage = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("prompt_tokens"), (F.col("user_id") % 7).alias("completion_tokens"))
    return summarize.usage_totals(usage, 100_000)


_TOKENS = r"cast(floor(len(list_filter(regexp_split_to_array('user' || chr(10) || text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')) * 1.35::double) as bigint) + 100"


@query(f"select doc_id, {_TOKENS} as cost, sum({_TOKENS}) over (order by doc_id) <= 200000 as admitted from documents")
def budget_admission(spark, sf_dir):
    """Documents as prompts, 100 tokens kept for each answer: those that a budget of 200,000 tokens lets through."""
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return summarize.admit(prompts, ["doc_id"], 200_000, 100).select("doc_id", "cost", "admitted")


@query("""with l as (select l_orderkey, l_linenumber, l_suppkey, datediff('day', date '1990-01-01', l_shipdate::date) as a, datediff('day', date '1990-01-01', l_shipdate::date) + l_quantity::int as b, l_returnflag from lineitem)
select x.l_orderkey, x.l_linenumber, count(*) as n from l x join l y on x.l_suppkey = y.l_suppkey and x.a <= y.b and y.a <= x.b where y.l_returnflag = 'R' group by all""")
def span_overlap(spark, sf_dir):
    """For each line item the supplier's returned ones whose days, one for each piece from shipping on, overlap its own."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", day.alias("a"), (day + F.col("l_quantity").cast("int")).alias("b"), "l_returnflag")
    back = rows.where("l_returnflag = 'R'").select("l_suppkey", F.col("a").alias("c"), F.col("b").alias("d"))
    return spans.overlapping(rows, back, "l_suppkey", ("a", "b"), ("c", "d")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("select event_id, '## [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z] ' || event_type || chr(10) || '- ' || props || chr(10) as entry from events")
def log_entries(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("event"), F.col("props").alias("detail"))
    return log.select("event_id", sinks.render_log().alias("entry"))


@query(r"""select target, count(*) as n from (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages) group by target""")
def link_counts(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n"))


@query(r"""select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) as n from pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.strip_tags("html")).cast("long").alias("n"))


@query("""with e as (select doc_id, quality, toxic, ['low', 'medium', 'high', 'odd'] as l, source from labels join documents using (doc_id))
select source, coalesce(['low', 'medium', 'high'][min(case when doc_id % 4 < 3 then doc_id % 4 + 1 end)], 'medium') as confidence from e group by source""")
def confidence_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    level = F.element_at(F.array(*map(F.lit, [*summarize.LEVELS, "odd"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return rows.select("source", level.alias("confidence")).groupBy("source").agg(summarize.merged_confidence().alias("confidence"))


@query("""select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(spark, sf_dir):
    from loam.streaming.updates import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""with e as (select 'user_' || user_id as path, event_type as hash, epoch_us(ts) as us, 64800000000 as gone from events),
wm as (select max(us) // 1000 - 600000 as wm from e),
k as (select *, lag(us) over w as last, lag(hash) over w as was, lead(us) over w as next from e window w as (partition by path order by us, hash)),
c as (select path, case when last is null or us > last + gone then 'added' else 'changed' end as change, hash, us from k where last is null or us > last + gone or was <> hash
union all select path, 'removed', null, us + gone from k, wm where next > us + gone or next is null and (us + gone) // 1000 + 1 <= wm)
select path, change, hash, us as at_us from c""")
def follow_events(spark, sf_dir):
    from loam.streaming.updates import CHANGES, follow_files

    events = table(spark, sf_dir, "events")
    # A stream of files wants a folder or a pattern, and the table may be one file: a pattern that one name meets.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.format_string("user_%d", "user_id").alias("path"), F.col("event_type").alias("hash"), F.col("ts").alias("seen"))
    root = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    follow_files(rows, root, f"{root}/checkpoint", lambda diff, n: None, timedelta(hours=18), once=True).awaitTermination()
    return sources.read_or_empty(spark, f"{root}/changes", CHANGES).select("path", "change", "hash", F.unix_micros("at").alias("at_us"))
