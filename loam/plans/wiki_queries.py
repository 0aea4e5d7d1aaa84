"""Queries over synthesised pages and summaries: lint, page maps, reduces, reports, lenses, diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import frontmatter
from loam.functions import text as T
from loam.functions.lineage import settle
from loam.operators import build, graph, incremental, lint, pages, parse, repomap, signals, summarize
from loam.plans import synth
from loam.plans.base import Register
from loam.sources import files as sources
from loam.sources import sinks

query = Register()
QUERIES, SQL = query.queries, query.sql
CODE, PAGES, NOTES = synth.CODE_SQL, synth.PAGES_SQL, synth.NOTES_SQL


@query(f"with {PAGES} select page, cite, status from status")
def lint_citations(spark, sf_dir):
    cited = lint.page_citations(synth.pages(spark, sf_dir))
    return lint.check_citations(cited, synth.code(spark, sf_dir)).select("page", "cite", "status")


@query(f"with {PAGES} select page, link from known where target is null")
def lint_links(spark, sf_dir):
    return lint.broken_links(lint.page_links(synth.pages(spark, sf_dir)))


@query(f"with {PAGES} select target as page, count(*) as n from known where target is not null group by target")
def lint_inbound(spark, sf_dir):
    return lint.inbound(lint.page_links(synth.pages(spark, sf_dir)))


@query(f"with {PAGES} select page from pg where page not in (select target from known where target is not null)")
def lint_orphans(spark, sf_dir):
    p = synth.pages(spark, sf_dir)
    return lint.orphans(p, lint.page_links(p))


_FOUND = """found as (select status || '_citations' as kind, page || ': ' || cite as item from status where status <> 'ok' union select 'broken_links', page || ' -> ' || link from known where target is null
union select 'missing_citations', page from pg where has_sources and not cites union select 'orphans', page from pg where page not in (select target from known where target is not null))"""


@query(f"with {PAGES}, {_FOUND} select kind, item, row_number() over (partition by kind order by item) as place from found")
def lint_report(spark, sf_dir):
    return lint.lint_report(lint.lint_findings(synth.pages(spark, sf_dir), synth.code(spark, sf_dir)))


@query(f"""with {PAGES}, {_FOUND}, c as (select kind, count(*) as n from found group by kind)
select 'pages=' || (select count(*) from pg) || string_agg(' ' || name || '=' || coalesce(n, 0), '' order by i) as summary
from (select * from (values (1, 'broken_links', 'broken_links'), (2, 'missing_citations', 'missing_citations'), (3, 'unresolved_citations', 'unresolved'), (4, 'stale_citations', 'stale'),
  (5, 'placeholder_citations', 'placeholders'), (6, 'orphans', 'orphans')) t(i, k, name) left join c on kind = k)""")
def lint_summary(spark, sf_dir):
    p = synth.pages(spark, sf_dir)
    return lint.lint_summary(lint.lint_findings(p, synth.code(spark, sf_dir)), p)


@query(f"with {CODE}, {PAGES.split('f as (')[0].replace('ns as (select count(*) as n from supplier), ', '')} f as ({PAGES.split('f as (')[1].replace('(select n from ns)', '(select n from n)').replace('pages, ns, np, f where s_suppkey = page_id % ns.n', 'pages, n, np, f where s_suppkey = page_id % n.n')}, span as (select page, file, last from status) select page, id as symbol_id from span join funcs on path = file where line <= last and line + 1 >= 2 union select page, path || '::Model_' || s || ':' || (4 + 2 * parts) from span join sizes on path = file where 4 + 2 * parts <= last")
def citation_overlap(spark, sf_dir):
    cited = lint.page_citations(synth.pages(spark, sf_dir))
    return incremental.citation_symbols(cited, parse.parse_python(synth.code(spark, sf_dir)))


@query(f"with {PAGES} select page, file as source_files, (file like 'nation%')::int as hashes from status")
def pagemap_build(spark, sf_dir):
    code = synth.code(spark, sf_dir)
    built = incremental.build_pagemap(lint.page_citations(synth.pages(spark, sf_dir)), parse.parse_python(code), code)
    return built.select("page", F.array_join("source_files", ";").alias("source_files"), F.size("file_hashes").alias("hashes"))


@query("select 'area_' || page_id % 4 || '/p' || page_id || '.md' as page, 'Page ' || page_id as title, 'page ' || page_id % 5 as summary from pages")
def page_metadata(spark, sf_dir):
    p = synth.pages(spark, sf_dir)
    section = F.regexp_replace(T.summary_section("text"), r" \[a\].*$", "")
    return p.select("page", sources.frontmatter_field("text", "title").alias("title"), section.alias("summary"))


@query("select page_id, url as title, page_id % 7 as rank, case when page_id % 5 = 0 then null else 2 end as sources, case when page_id % 3 = 0 then 'team ' || page_id % 4 end as owner from pages")
def page_frontmatter(spark, sf_dir):
    """Heads with quoted addresses, nested mappings and lists, read back as values; every fifth list is missing."""
    p = synth.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    head = F.concat(
        F.lit("---\ntitle: '"), F.replace("url", F.lit("'"), F.lit("''")), F.lit("'\nmeta:\n  rank: "), i % 7, F.when(i % 3 == 0, F.concat(F.lit("\n  owner: team "), i % 4)).otherwise(""),
        F.when(i % 5 == 0, F.lit("\nsources:\n")).otherwise(F.lit("\nsources:\n- a.py:L1-L2\n- \"b: c\"\n")), F.lit("---\nbody\n"),
    )
    value = frontmatter.frontmatter_value("text")
    rows = p.select("page_id", head.alias("text")).select("page_id", value.alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("page_id", get("$.title", "string").alias("title"), get("$.meta.rank", "long").alias("rank"), F.nullif(F.size(get("$.sources", "array<string>")), F.lit(-1)).alias("sources"), get("$.meta.owner", "string").alias("owner"))


@query("select 'area_' || page_id % 4 || '/p' || page_id || '.md' as page from pages where page_id % 10 = 0")
def summary_contradictions(spark, sf_dir):
    p = synth.pages(spark, sf_dir)
    number = F.regexp_extract("page", r"p(\d+)\.md", 1).cast("int")
    after = p.withColumn("text", F.when(number % 10 == 0, F.replace("text", F.lit("## Summary\n"), F.lit("## Summary\nNew. "))).otherwise(F.col("text")))
    return incremental.changed_summaries(p, after)


@query("""select 'area_' || page_id % 4 as folder, string_agg('- [P' || page_id || '](area_' || page_id % 4 || '/p' || page_id || '.md)', chr(10) order by 'p' || page_id || '.md') as entries from pages group by page_id % 4""")
def page_index(spark, sf_dir):
    return sinks.page_index(synth.pages(spark, sf_dir).select(F.col("page").alias("rel_path")))


@query("select 'area_' || page_id % 4 as folder, count(*) as n from pages group by page_id % 4")
def pages_per_folder(spark, sf_dir):
    return synth.pages(spark, sf_dir).groupBy(T.folder("page").alias("folder")).agg(F.count("*").alias("n"))


def _parsed(spark, sf_dir):
    """Files and symbols, made and parsed once for all that read them."""
    files = settle(synth.code(spark, sf_dir))
    return files, settle(parse.parse_python(files))


def _found(spark, sf_dir):
    files = settle(synth.code(spark, sf_dir))
    return settle(signals.detect_signals(files, parse.parse_python(files)))


def _code(spark, sf_dir):
    files, symbols = _parsed(spark, sf_dir)
    return files, symbols, settle(signals.detect_signals(files, symbols))


@query(f"""with {CODE}, names as (select s, 0 as g, p as k, 'part_' || p as name, parts.k as pos from parts union all select s, 1, s, 'Model_' || s, 1000000 from supp),
r as (select *, row_number() over (partition by s order by case when g = 1 then parts else pos end) as r from names join (select s, parts from sizes) using (s)),
top as (select s, string_agg(name, ',' order by r) as key_symbols from r where r <= 8 group by s)
select path, 'low' as confidence, path || ':L1-L1' as citation, key_symbols from supp join top using (s)""")
def file_summaries(spark, sf_dir):
    files, symbols = _parsed(spark, sf_dir)
    rows = summarize.fallback_summaries(files, symbols)
    return rows.select("path", "confidence", F.array_join("citations", ",").alias("citation"), F.array_join("key_symbols", ",").alias("key_symbols"))


@query(f"""with {CODE}, caps as (select 'nation_' || k as component, 'area ' || k as label from supp union select 'nation_' || k, 'Model_' || s from supp),
cites as (select 'nation_' || k as component, path, s, row_number() over (partition by k order by s) as r from supp)
select component, (select string_agg(label, ',' order by label) from caps x where x.component = c.component) as capabilities, string_agg(path, ',' order by path) as files,
string_agg(case when r <= 24 then path || ':L1-L1' end, ',' order by s) as citations, 'low' as confidence from cites c group by component""")
def module_reduce(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    rows = summarize.reduce_components(summarize.fallback_summaries(files, symbols), found)
    joined = [F.array_join(c, ",").alias(c) for c in ("capabilities", "files", "citations")]
    return rows.select("component", *joined, "confidence")


@query(f"""with {CODE} select 'Covers ' || (select count(*) from supp) || ' files in ' || (select count(distinct k) from supp) || ' components with ' || ((select count(*) from funcs) + (select count(*) from supp)) || ' symbols.' as executive_summary, 'low' as confidence""")
def system_reduce(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    parts = summarize.reduce_components(summarize.fallback_summaries(files, symbols), found)
    return summarize.reduce_system(parts, files, symbols, repomap.framework_hints(files), repomap.entrypoints(files)).select("executive_summary", "confidence")


@query(f"""with {CODE} select 'area_' || k as capability, count(*) as routes, string_agg(path || ':L3-L3', ';' order by path) as evidence, 'nation_' || k as components from supp group by k""")
def capability_groups(spark, sf_dir):
    rows = pages.capability_groups(_found(spark, sf_dir))
    return rows.select("capability", F.size("routes").cast("long").alias("routes"), F.array_join("evidence", ";").alias("evidence"), F.array_join("components", ";").alias("components"))


@query(f"with {CODE} select 'nation_' || k as component, 'area ' || k as capability from supp union select 'nation_' || k, 'Model_' || s from supp")
def capabilities_by_component(spark, sf_dir):
    return summarize.capabilities_by_component(_found(spark, sf_dir)).select("component", F.explode("capabilities").alias("capability"))


@query(f"with {CODE} select 'area_' || k as capability, path from supp")
def capability_files(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    return pages.capability_summaries(pages.capability_groups(found), summarize.fallback_summaries(files, symbols))


@query(f"""with {CODE}, d as (select a.k as a, b.k as b, a.path, b.path as dep from supp a join supp b on a.dep = b.s where a.k <> b.k),
x as (select 'needs' as way, 'nation_' || a as component, dep as path from d union select 'used', 'nation_' || b, path from d)
select way, component, path from (select *, row_number() over (partition by way, component order by path) as r from x) where r <= 20""")
def component_links(spark, sf_dir):
    files, symbols = _parsed(spark, sf_dir)
    edges = graph.build_edges(files, symbols, repomap.resolve_imports(files, symbols))
    needs, used = pages.component_links(graph.file_dependencies(edges))
    rows = needs.select(F.lit("needs").alias("way"), "component", "paths").union(used.select(F.lit("used"), "component", "paths"))
    return rows.select("way", "component", F.explode("paths").alias("path"))


@query(f"with {CODE} select 'Model_' || s as name from supp")
def glossary_entities(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    return pages.data_entities(found, summarize.fallback_summaries(files, symbols))


@query(f"""with {CODE} select count(*) as routes, 0 as integrations, (select count(*) from deps) * 2 + (select count(*) from funcs) + (select count(*) from supp) + (select count(*) from funcs a join funcs b on a.callee = b.p where a.p <> b.p) as edges from supp""")
def onboarding_scores(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    edges = graph.build_edges(files, symbols, repomap.resolve_imports(files, symbols))
    return signals.onboarding_scores(found, edges)


@query(f"""with {NOTES}, t as (select path, 'notes' as lang, c, string_agg('order ' || o || ' ' || case w when '1' then 'email kafka' when '2' then 'token queue' when '3' then 'payment audit' when '4' then 'manual review' else 'batch ledger' end, chr(10) order by o) || chr(10) as text from lines group by all)
select path, length(text) as n, sha256(text) as hash from t""")
def notes_files(spark, sf_dir):
    return synth.notes(spark, sf_dir).select("path", F.length("text").cast("long").alias("n"), "hash")


_PROMPTS = f"""with {CODE}, names as (select s, p as k, 'part_' || p as name, parts.k as pos from parts union all select supp.s, s, 'Model_' || supp.s, parts from supp join sizes using (s)),
symbols as (select s, string_agg(name, ', ' order by pos) as names from (select *, row_number() over (partition by s order by pos) as r from names) where r <= 12 group by s),
bodies as (select s, string_agg('def part_' || p || '():' || chr(10) || '    return part_' || callee || '()' || chr(10), '' order by p) as body from parts group by s),
prompts as (select supp.path, 'Describe this source file as JSON. Ground every claim in path:Lx-Ly citations; say unknown where the code does not tell.' || chr(10) || 'Path: ' || supp.path || chr(10) || 'Language: python' || chr(10)
  || 'Symbols: ' || names || chr(10) || 'Signals: GET /area_' || k || '/' || supp.s || ', Model_' || supp.s || chr(10) || 'Content:' || chr(10)
  || left('import nation_' || dk || '.supp_' || ds || chr(10) || 'import os' || chr(10) || '@app.get("/area_' || k || '/' || supp.s || '")' || chr(10) || body || 'class Model_' || supp.s || '(Base):' || chr(10) || '    pass' || chr(10), 12000) as prompt
  from supp join deps using (s) join symbols using (s) join bodies using (s))"""


@query(f"{_PROMPTS} select path, prompt from prompts")
def prompt_file(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    return summarize.file_prompts(files, symbols, found)


@query(f"""{_PROMPTS} select count(*) as prompts, sum(cast(floor(len(list_filter(regexp_split_to_array('user' || chr(10) || prompt, '[ \\n]+'), lambda w: w <> '')) * 1.35::double) as int))::bigint as tokens from prompts""")
def dry_run_tokens(spark, sf_dir):
    files, symbols, found = _code(spark, sf_dir)
    return summarize.token_plan(summarize.file_prompts(files, symbols, found))


def _counted(table: str) -> str:
    """SQL: prompts and estimated tokens of a table of prompts."""
    words = "len(list_filter(regexp_split_to_array('user' || chr(10) || prompt, '[ \\n]+'), lambda w: w <> ''))"
    return f"select count(*) as prompts, sum(cast(floor({words} * 1.35::double) as int))::bigint as tokens from {table}"


@query(f"""{_PROMPTS}, caps as (select k, 'area ' || k as label from supp union select k, 'Model_' || s from supp),
ranked as (select k, label, row_number() over (partition by k order by label) as r from caps),
listed as (select k, string_agg(label, ', ' order by r) as every, string_agg(label, ', ' order by r) filter (r <= 5) as few from ranked group by k),
seen as (select k, s, path, row_number() over (partition by k order by s) as r, min(s) over (partition by k) as first from supp),
told as (select 'Holds part of this component''s implementation.' as t),
parts_p as (select 'Summarise this component as JSON: nation_' || k || chr(10) || 'Capabilities: ' || any_value(every) || chr(10)
  || string_agg('- ' || path || ': ' || t || ' [' || path || ':L1-L1] data: ', chr(10) order by s) filter (r <= 14) as prompt from seen join listed using (k), told group by k),
lines as (select k, '- nation_' || k || ': ' || any_value(t) || ' {{' || any_value(few) || '}} [' || string_agg(path || ':L1-L1', ', ' order by s) filter (r <= 2) || ']' as line, min(first) as first from seen join listed using (k), told group by k),
system_p as (select 'Summarise this system as JSON.' || chr(10) || string_agg(line, chr(10) order by first) as prompt from (select * from lines order by first limit 16)),
levels as (select 0 as step, 'files' as level, * from ({_counted("prompts")}) union all select 1, 'components', * from ({_counted("parts_p")}) union all select 2, 'system', * from ({_counted("system_p")}))
select level, prompts, tokens, (1000000 - sum(tokens) over (order by step))::bigint as remaining from levels""")
def dry_run_levels(spark, sf_dir):
    """What a run would send at each level, and what that leaves of a budget of a million tokens."""
    files, symbols, found = _code(spark, sf_dir)
    told = summarize.fallback_summaries(files, symbols)
    parts = settle(summarize.reduce_components(told, found))
    return summarize.run_plan(summarize.file_prompts(files, symbols, found), summarize.component_prompts(parts, told), summarize.system_prompt(parts), 1_000_000)


@query(f"""with {CODE}, shown as (select s, path, 'file_' || regexp_replace(path, '[:/.-]', '_', 'g') as node from supp order by s limit 30),
rows as (select 0 as part, lpad(s::varchar, 10, '0') as key, '    ' || node || '[' || path || ']' as line from shown
union all select 1, 'file:' || a.path || ' file:' || b.path, '    ' || a.node || ' --> ' || b.node from deps d join shown a on d.path = a.path join shown b on d.dep = b.path
union all select 2, '', '    external_os[os]:::external'
union all select 4, '', '    more4[+' || (count(*) - 30) || ' more]' from supp having count(*) > 30)
select 'flowchart TD' || chr(10) || string_agg(line, chr(10) order by part, key) || chr(10) || '    classDef external fill:#f9f' as diagram from rows""")
def mermaid_component(spark, sf_dir):
    files, symbols = _parsed(spark, sf_dir)
    edges = settle(graph.build_edges(files, symbols, repomap.resolve_imports(files, symbols)))
    return pages.component_graph_diagram(files, edges)


@query()
def report_pages(spark, sf_dir):
    """All pages of a build, rendered."""
    files = settle(synth.code(spark, sf_dir))
    return pages.build_pages(files, parse.parse_python(files)).select("rel_path", "title", sinks.render_page().alias("rendered"))


#: Pages of every build whatever the source: path, title, type.
_ALWAYS = [
    ("00-overview/component-graph.md", "Component Graph", "overview"), ("00-overview/executive-summary.md", "Executive Summary", "overview"),
    ("00-overview/system-context.md", "System Context", "overview"), ("00-overview/tech-stack.md", "Tech Stack", "overview"),
    ("compliance/data-flow-map.md", "Data Flow Map", "lens"), ("domain/data-model.md", "Data Model", "domain"), ("domain/glossary.md", "Glossary", "domain"),
    ("integrations/external-systems.md", "External Systems", "integration"), ("onboarding/first-week.md", "First Week", "lens"),
    ("operations/setup.md", "Setup", "operations"), ("opportunities/opportunity-register.md", "Opportunity Register", "lens"),
    ("risks/risk-register.md", "Risk Register", "risk"), ("security/threat-surface.md", "Threat Surface", "lens"),
]


@query(f"""with {CODE}, k as (select k, min(s) as s from supp group by k)
select 'components/nation-' || k || '.md' as rel_path, 'nation_' || k as title, 'component' as type, 'Told by the model.' as told from k union all
select 'capabilities/area-' || k || '.md', 'Area ' || k, 'capability', '' from k union all select 'workflows/area-' || k || '.md', 'Area ' || k || ' Workflow', 'workflow', '' from k union all
select *, '' from (values {", ".join(str(row) for row in _ALWAYS)})""")
def build_told(spark, sf_dir):
    """All pages of a build whose summaries a model tells: path, title, type, and of components what it has told."""
    files = settle(synth.code(spark, sf_dir))
    answer = F.lit('{"responsibility": "Told by the model.", "confidence": "high"}')
    made = build.generate(files, parse.parse_python(files), lambda prompt: F.when(F.col(prompt).isNotNull(), answer)).pages
    return made.select("rel_path", "title", "type", F.when(F.col("type") == "component", F.col("summary")).otherwise("").alias("told"))
