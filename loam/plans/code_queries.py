"""Queries over synthesised source trees: parsing, imports, calls, signals, the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import settle
from loam.operators import chunks, graph, parse, repomap, signals
from loam.plans import synth
from loam.plans.base import Register

query = Register()
QUERIES, SQL = query.queries, query.sql
CODE, NOTES, EDGES = synth.CODE_SQL, synth.NOTES_SQL, synth.EDGES_SQL


@query(f"""with {CODE} select id, 'function' as kind, 'part_' || p as name, path, line as start_line, line + 1 as end_line from funcs
union all select path || '::Model_' || s || ':' || (4 + 2 * parts), 'class', 'Model_' || s, path, 4 + 2 * parts, 5 + 2 * parts from sizes""")
def parse_symbols(spark, sf_dir):
    found = parse.parse_symbols(synth.code(spark, sf_dir))
    return found.select("id", "kind", "name", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"with {CODE} select id, 'part_' || callee as callee from funcs union all select id, 'get' from funcs where line = 4")
def parse_calls(spark, sf_dir):
    return parse.parse_python(synth.code(spark, sf_dir)).where("kind = 'function'").select("id", F.explode("calls").alias("callee"))


@query(f"with {CODE} select path, unnest(['nation_' || dk || '.supp_' || ds, 'os']) as name from deps")
def parse_imports(spark, sf_dir):
    return parse.parse_python(synth.code(spark, sf_dir)).select("path", F.explode("imports").alias("name")).distinct()


@query("""select 'web/app/cust_' || c_custkey || '.ts::handle_' || c_custkey || ':3' as id, 'function' as kind from customer union all
select 'web/app/cust_' || c_custkey || '.ts::Cust' || c_custkey || ':5', 'class' from customer union all select 'web/shared/base.ts::base:1', 'function'""")
def parse_script(spark, sf_dir):
    return parse.parse_script(synth.script(spark, sf_dir)).select("id", "kind")


@query("""with p as (select 'src/Part' || p_partkey || '.java' as path, p_partkey as p from part)
select path || '::Part' || p || ':3' as id, 'class' as kind, '' as calls from p union all select path || '::find:6', 'function', 'load' from p union all select path || '::Item' || p || ':13', 'class', '' from p""")
def parse_java(spark, sf_dir):
    return parse.PARSERS["java"](synth.java(spark, sf_dir)).select("id", "kind", F.array_join("calls", ",").alias("calls"))


def _declared(files, lang):
    lists = [F.array_join(c, ",").alias(c) for c in ("calls", "imports")]
    return parse.PARSERS[lang](files).select("id", "kind", "start_line", "end_line", "signature", *lists)


@query("""with p as (select 'go/n' || s_nationkey || '/supp_' || s_suppkey || '.go' as path, s_suppkey as s, 'fmt,corp/base' as imports from supplier)
select path || '::Supp' || s || ':9' as id, 'class' as kind, 9 as start_line, 11 as end_line, 'Supp' || s || '[T any] struct {' as signature, '' as calls, imports from p union all
select path || '::Load' || s || ':13', 'function', 13, 16, 'func (s *Supp' || s || '[T]) Load' || s || '(x int) interface{} {', 'Println,y,Step', imports from p""")
def parse_go(spark, sf_dir):
    return _declared(synth.go(spark, sf_dir), "go")


@query("""with p as (select 'cs/Part' || p_partkey || '.cs::' as path, p_partkey as p, p_size as n, 'System,System.Math' as imports from part)
select path || 'Part' || p || ':5' as id, 'class' as kind, 5 as start_line, 14 as end_line, 'public sealed class Part' || p || '<T> : Base where T : class, new() {' as signature, '' as calls, imports from p union all
select path || 'Inner:7', 'class', 7, 7, 'class Inner { public int Size() => Calc(' || n || '); }', '', imports from p union all
select path || 'Size:7', 'function', 7, 7, 'public int Size() => Calc(' || n || ');', 'Calc', imports from p union all
select path || 'Part' || p || ':8', 'function', 8, 8, 'public Part' || p || '(int x) : base(x) { Init(); }', 'Init', imports from p union all
select path || 'Sum:9', 'function', 9, 13, 'public List<(int a, T b)> Sum<U>(List<U> xs) where U : class {', 'ToList,Where,Keep' || p || ',Open,T', imports from p""")
def parse_csharp(spark, sf_dir):
    return _declared(synth.csharp(spark, sf_dir), "csharp")


@query("""select 'web/app/cust_' || c_custkey || '.ts' as src, unnest(['web/app/cust_' || (c_custkey % 10 + 1) || '.ts', 'web/shared/base.ts']) as dep, true as is_internal from customer""")
def import_resolve_script(spark, sf_dir):
    files = synth.script(spark, sf_dir)
    return repomap.resolve_imports(files, parse.parse_script(files)).select("src", "dep", "is_internal")


def _code(spark, sf_dir):
    files = synth.code(spark, sf_dir)
    return files, parse.parse_python(files)


@query(f"with {CODE} select path as src, dep, true as is_internal, 1::bigint as ord from deps union all select path, 'os', false, 2::bigint from deps")
def import_resolve(spark, sf_dir):
    return repomap.resolve_imports(*_code(spark, sf_dir))


@query(f"with {CODE} select a.id as src, b.id as dst from funcs a join funcs b on a.callee = b.p where a.p <> b.p")
def call_resolve(spark, sf_dir):
    return graph.resolve_calls(_code(spark, sf_dir)[1]).select("src", "dst")


def _graph(spark, sf_dir):
    files = synth.code(spark, sf_dir)
    symbols = settle(parse.parse_python(files))
    imports = repomap.resolve_imports(files, symbols)
    nodes = graph.build_nodes(files, symbols, imports)
    return files, symbols, nodes, graph.referential(graph.build_edges(files, symbols, imports), nodes)


@query(f"""with {CODE} select 'file:' || path as src, 'file:' || dep as dst, 'imports' as edge_type from deps union all select 'file:' || path, 'external:os', 'imports' from deps
union all select a.id, b.id, 'calls' from funcs a join funcs b on a.callee = b.p where a.p <> b.p
union all select 'file:' || path, id, 'defines' from funcs union all select 'file:' || path, path || '::Model_' || s || ':' || (4 + 2 * parts), 'defines' from sizes""")
def code_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[3].select("src", "dst", "edge_type")


@query(f"""with {CODE} select 'file:' || path as id, 'file' as kind from supp union all select id, 'function' from funcs union all select path || '::Model_' || s || ':' || (4 + 2 * parts), 'class' from sizes
union all select 'external:os', 'external'""")
def code_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[2].select("id", "kind")


@query(f"with {CODE} select path, parts + 1 as symbols from sizes")
def symbols_per_file(spark, sf_dir):
    return _code(spark, sf_dir)[1].groupBy("path").agg(F.count("*").alias("symbols"))


@query(f"with {CODE} select dep as path, path as dependent from deps")
def graph_dependents(spark, sf_dir):
    return graph.file_dependents(_graph(spark, sf_dir)[3])


@query(f"with {CODE} select path, dep from deps")
def graph_dependencies(spark, sf_dir):
    return graph.file_dependencies(_graph(spark, sf_dir)[3])


@query(f"""with {CODE}, calls as (select a.path, 'part_' || b.p as callee, count(*) as n, min(a.line) as first from funcs a join funcs b on a.callee = b.p where a.p <> b.p group by a.path, b.p),
top as (select path, string_agg(callee || ' (' || n || ')', ',' order by n desc, first) as calls from (select *, row_number() over (partition by path order by n desc, first) as r from calls) where r <= 8 group by path)
select s.path, (select string_agg(dep, ',' order by dep) from deps d where d.path = s.path) as imports,
(select string_agg(distinct path, ',' order by path) from deps d where d.dep = s.path) as dependents, calls from supp s left join top using (path)""")
def neighbor_context(spark, sf_dir):
    files, symbols, nodes, edges = _graph(spark, sf_dir)
    rows = graph.neighbor_context(edges, symbols)
    return rows.select("path", F.array_join("imports", ",").alias("imports"), F.array_join("dependents", ",").alias("dependents"), F.array_join("calls", ",").alias("calls"))


@query(f"with {EDGES} select src, dst from e")
def graph_successors(spark, sf_dir):
    e = synth.edges(spark, sf_dir)
    return graph.successors(e, e.select(F.col("src").alias("id")).distinct())


def _reach_sql(a: str, b: str) -> str:
    return f"""with recursive {EDGES}, seeds as (select distinct src as id from e),
r as (select id as seed, {b} as node from seeds join e on {a} = id union select seed, {b} from r join e on {a} = node) select seed, node from r where seed <> node"""


def _seeds(e):
    return e.select(F.col("src").alias("id")).distinct()


@query(_reach_sql("e.dst", "e.src"))
def graph_ancestors(spark, sf_dir):
    e = synth.edges(spark, sf_dir)
    return graph.ancestors(e, _seeds(e), hops=24)  # import chains of this depth are cheaper followed than doubled


@query(_reach_sql("e.src", "e.dst"))
def graph_descendants(spark, sf_dir):
    e = synth.edges(spark, sf_dir)
    return graph.descendants(e, _seeds(e), hops=24)


@query(f"""with recursive {EDGES}, r as (select src as seed, dst as node from e union select seed, dst from r join e on src = node)
select a.seed as node, least(min(a.node), a.seed) as scc from r a join r b on a.seed = b.node and a.node = b.seed group by a.seed""")
def graph_scc(spark, sf_dir):
    return graph.strong_components(synth.edges(spark, sf_dir))


@query(f"""with recursive {EDGES}, p as (select src as first, dst as last, [src] as path from e union all
select first, e.dst, list_append(path, last) from p join e on e.src = p.last where last > first and not list_contains(path, last))
select array_to_string(path, '>') as cycle from p where first = last""")
def graph_cycles(spark, sf_dir):
    return graph.simple_cycles(synth.edges(spark, sf_dir)).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"with {EDGES} select src, dst from e where right(src, 1) in ('1', '2', '3', '4', '5') and right(dst, 1) in ('1', '2', '3', '4', '5')")
def graph_subgraph(spark, sf_dir):
    e = synth.edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("kind", F.lit("file"))
    keep = nodes.where(F.right("id", F.lit(1)).isin("1", "2", "3", "4", "5"))
    return graph.subgraph(nodes, e, keep)[1].select("src", "dst")


@query("select 'external:os' as id")
def external_nodes(spark, sf_dir):
    _, _, nodes, edges = _graph(spark, sf_dir)
    return graph.incident_nodes(nodes, edges, True).select("id")


@query(f"""with recursive {EDGES}, seeds as (select distinct src as id from e),
r as (select id as seed, e.src as node from seeds join e on e.dst = id union select seed, e.src from r join e on e.dst = node),
map as (select 'file:' || s_suppkey as f, 'components/n' || s_nationkey || '.md' as page from supplier)
select distinct seed, page from r join map on f = node where seed <> node""")
def impact_pages(spark, sf_dir):
    e = synth.edges(spark, sf_dir)
    s = synth.table(spark, sf_dir, "supplier")
    page = F.format_string("components/n%d.md", "s_nationkey")
    pagemap = s.groupBy(page.alias("page")).agg(F.collect_set(F.col("s_suppkey").cast("string")).alias("source_files"))
    return graph.impacted_pages(graph.impact(e, _seeds(e)), pagemap)


@query(f"with {CODE} select 'GET /area_' || k || '/' || s as name, path || ':L3-L3' as cite from supp")
def signals_routes(spark, sf_dir):
    return signals.evidence_rows(signals.detect_hits(*_code(spark, sf_dir))).where("type = 'api_route'").select("name", "cite")


@query(f"with {CODE} select 'Model_' || s as name, path || ':L' || (4 + 2 * parts) || '-L' || (4 + 2 * parts) as cite from sizes")
def signals_models(spark, sf_dir):
    return signals.evidence_rows(signals.detect_hits(*_code(spark, sf_dir))).where("type = 'data_model'").select("name", "cite")


@query(f"with {NOTES} select 'messaging' as type, 'Queue/Topic Integration' as name, string_agg(cite, ';' order by c) as evidence from (select distinct c, path || ':L1-L1' as cite from lines where w in ('1', '2'))")
def signals_keyword(spark, sf_dir):
    notes = synth.notes(spark, sf_dir)
    found = signals.collect(signals.capped(signals.hits(notes, signals.BASE_RULES)))
    return found.select("type", "name", F.array_join("evidence", ";").alias("evidence"))


@query("""with p as (select p_partkey as p, 'src/Part' || p_partkey || '.java' as path, regexp_replace(p_brand, '[^0-9]', '', 'g') as b from part)
select 'api_route' as type, 'ANY /brand_' || b as name, string_agg(path || ':L2-L2', ';' order by p) as evidence from p group by b union all
select 'api_route', 'GET /part/' || p, path || ':L4-L4' from p union all select 'data_model', 'Item' || p, path || ':L12-L12' from p union all
select 'scheduled_job', 'Spring Scheduled Job', string_agg(path || ':L9-L9', ';' order by p) from p union all
select 'messaging', 'Kafka t' || s, string_agg(path || ':L10-L10', ';' order by p) from (select p.*, p_size as s from p join part on p = p_partkey) group by s""")
def signals_spring(spark, sf_dir):
    return signals.collect(signals.spring_hits(synth.java(spark, sf_dir))).select("type", "name", F.array_join("evidence", ";").alias("evidence"))


_CAPPED = f"""with {NOTES}, hit as (select c, path, line, case %s end as type from lines), f as (select * from hit where type is not null),
k as (select *, row_number() over (partition by type, c order by line) as k from f), s as (select *, count(*) over (partition by type order by c, line rows between unbounded preceding and 1 preceding) as before from k where k <= 40)
select type, path || ':L' || line || '-L' || line as cite from s where before < 40 or k = 1"""


_COMPLIANCE = (
    _CAPPED % "when w = '1' then 'compliance_pii' when w = '3' then 'compliance_pci'"
    + f""" union all select 'compliance_log', path || ':L' || line || '-L' || line from (select *, count(*) over (order by c, line rows between unbounded preceding and 1 preceding) as before, row_number() over (partition by c order by line) as k from lines where w = '3') where before < 40 or k = 1
union all select 'compliance_egress', path || ':L' || line || '-L' || line from (select *, count(*) over (order by c, line rows between unbounded preceding and 1 preceding) as before, row_number() over (partition by c order by line) as k from lines where w = '1') where before < 40 or k = 1"""
)


@query(_COMPLIANCE)
def lens_compliance(spark, sf_dir):
    return signals.evidence_rows(signals.capped(signals.hits(synth.notes(spark, sf_dir), signals.COMPLIANCE_RULES))).select("type", "cite")


@query((_CAPPED % "when w = '2' then 'security_auth'").replace("select type, path", "select type, 'Authentication/Authorization Flow' as name, path"))
def lens_security(spark, sf_dir):
    return signals.evidence_rows(signals.capped(signals.hits(synth.notes(spark, sf_dir), signals.SECURITY_RULES))).select("type", "name", "cite")


_OPP = f"""with {NOTES}, m as (select c, path, line, 'manual_review_queue' as name, case w when '4' then 2 when '2' then 1 end as hits from lines union all select c, path, line, 'batch_reconciliation', case w when '5' then 2 end from lines),
h as (select *, coalesce(sum(hits) over (partition by name, c order by line rows between unbounded preceding and 1 preceding), 0) as before from m where hits is not null),
kept as (select name, path || ':L' || line || '-L' || line as cite from h where before < 4)"""


@query(f"{_OPP} select name, cite from kept")
def lens_opportunity(spark, sf_dir):
    return signals.evidence_rows(signals.capped(signals.hits(synth.notes(spark, sf_dir), signals.OPPORTUNITY_RULES))).select("name", "cite")


@query(f"""{_OPP}, s as (select name, round(count(*) * 2.5 + 1.5, 2)::double as score from kept group by name)
select row_number() over (order by score desc, name desc) as rank, name, score from s union all select 3, 'rule_engine_density', 0.5::double""")
def opportunity_score(spark, sf_dir):
    hits = signals.capped(signals.hits(synth.notes(spark, sf_dir), signals.OPPORTUNITY_RULES))
    found = settle(signals.collect_first(hits, len(signals.PRIORITIES)))
    return signals.opportunity_register(found, 1000, count=F.col("n")).select(F.col("rank").cast("long").alias("rank"), "name", "score")


@query(f"select type, count(*)::double as score from ({_COMPLIANCE}) group by type")
def lens_scores(spark, sf_dir):
    return signals.score_rows(signals.capped(signals.hits(synth.notes(spark, sf_dir), signals.COMPLIANCE_RULES)), "compliance")


@query("select 'Spring' as label")
def framework_hints(spark, sf_dir):
    return repomap.framework_hints(synth.java(spark, sf_dir))


@query(f"with {CODE} select path from supp where s % 10 = 0 union all select 'app_' || s || '/main.py' from supp where s % 10 = 1")
def entrypoints(spark, sf_dir):
    files = synth.code(spark, sf_dir)
    guard = F.when(F.col("pos") % 10 == 0, F.concat("text", F.lit('if __name__ == "__main__":\n    pass\n'))).otherwise(F.col("text"))
    path = F.when(F.col("pos") % 10 == 1, F.format_string("app_%d/main.py", "pos")).otherwise(F.col("path"))
    return repomap.entrypoints(files.withColumn("text", guard).withColumn("path", path))


@query(f"""with {CODE} select path || ':L' || line || '-L' || (line + 1) as cite, 'part_' || p as symbol, 'function' as kind, 'def part_' || p || '():' || chr(10) || '    return part_' || callee || '()' as text from funcs
union all select path || ':L' || (4 + 2 * parts) || '-L' || (5 + 2 * parts), 'Model_' || s, 'class', 'class Model_' || s || '(Base):' || chr(10) || '    pass' from sizes""")
def chunk_symbols(spark, sf_dir):
    return chunks.chunk_symbols(*_code(spark, sf_dir)).select("cite", "symbol", "kind", "text")


@query(f"with {CODE} select path, 'nation_' || k as component, 'python' as lang, 'nation_' || k || '_supp_' || s || '_py' as node from supp")
def file_metadata(spark, sf_dir):
    files = synth.code(spark, sf_dir)
    return files.select("path", T.component("path").alias("component"), T.language("path").alias("lang"), T.mermaid_id("path").alias("node"))
