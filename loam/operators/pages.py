"""Report pages as rows: overview, components, capabilities, domain, lenses, diagrams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import text as T
from loam.functions.lineage import firsts, settle
from loam.operators import graph, repomap, summarize
from loam.operators import signals as S
from loam.operators.mentions import mentions

NAMES = [x.strip().split(" ")[0] for x in schemas.PAGES.replace("struct<heading:string,body:string>", "s").split(",")]


def page_row(path: Column, title: Column, kind: str, audience: str, summary: Column, sections: list[tuple[str, Column]], sources: Column, related: Column | None = None, tags: tuple[str, ...] = (), confidence: Column | None = None) -> list[Column]:
    """The columns of a page; sections with an empty or null body are left out."""
    none = F.array().cast("array<string>")
    rows = [F.when(b != "", F.struct(F.lit(h).alias("heading"), b.alias("body"))) for h, b in sections]
    parts = F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<heading:string,body:string>>")
    values = [path, title, F.lit(kind), F.lit(audience), summary, parts, F.coalesce(sources, none), related if related is not None else none]
    values += [F.array(*map(F.lit, tags)).cast("array<string>"), confidence if confidence is not None else F.lit(None).cast("string")]
    return [v.alias(n) for v, n in zip(values, NAMES)]


def bullets(items: Column, most: int = 20) -> Column:
    shown = F.slice(F.coalesce(items, F.array().cast("array<string>")), F.lit(1), F.lit(most))
    return F.when(F.size(shown) > 0, F.concat(F.lit("- "), F.array_join(shown, "\n- "))).otherwise("")


def _collected(df: DataFrame, column: str, most: int = 1000) -> Column:
    """A small table's column as one sorted array, as a scalar."""
    return df.select(F.col(column).alias("v")).distinct().orderBy("v").limit(most).agg(F.array_sort(F.collect_list("v"))).scalar()


# Diagrams


def system_context_diagram(signals: DataFrame, frameworks: DataFrame) -> DataFrame:
    """``diagram``: the system, its first eight integrations by name, and its stack."""
    names = signals.where("type = 'integration'").select("name").distinct().orderBy("name").limit(8)
    lines = names.agg(F.array_sort(F.collect_list(F.concat(F.lit("    System --> "), T.mermaid_id("name"), F.lit("["), "name", F.lit("]")))).alias("lines"))
    stack = F.array_join(F.slice(F.coalesce(_collected(frameworks, "label"), F.array().cast("array<string>")), F.lit(1), F.lit(4)), ", ")
    tail = F.when(stack != "", F.array(F.concat(F.lit("    System --> Stack["), stack, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return lines.select(F.array_join(F.concat(F.array(F.lit("flowchart LR"), F.lit("    User --> System")), "lines", tail), "\n").alias("diagram"))


def component_graph_diagram(files: DataFrame, edges: DataFrame, most: int = 30, outside: int = 5) -> DataFrame:
    """``diagram``: the first files at an edge, imports among them, a few external modules, and how many are left out."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    own = files.select(F.concat(F.lit("file:"), "path").alias("id"), "path", "pos").join(ends, "id", "left_semi")
    shown = own.orderBy("pos").limit(most)
    pairs = edges.where("edge_type = 'imports'").select("src", "dst").distinct()
    kept = pairs.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    external = ends.where(F.startswith("id", F.lit("external:")))
    node = F.concat(F.lit("    "), T.mermaid_id("id"), F.lit("["), "path", F.lit("]"))
    rows = shown.select(F.lit(0).alias("part"), F.format_string("%010d", "pos").alias("key"), node.alias("line"))
    rows = rows.union(kept.select(F.lit(1), F.concat("src", F.lit(" "), "dst"), F.concat(F.lit("    "), T.mermaid_id("src"), F.lit(" --> "), T.mermaid_id("dst"))))
    label = F.concat(F.lit("    "), T.mermaid_id("id"), F.lit("["), F.substring("id", 10, 10_000), F.lit("]:::external"))
    rows = rows.union(external.orderBy("id").limit(outside).select(F.lit(2), "id", label))
    more = lambda df, n, part, text: df.agg(F.count("*").alias("n")).where(f"n > {n}").select(F.lit(part), F.lit(""), F.concat(F.lit("    more"), F.lit(str(part)), F.lit("[+"), F.col("n") - n, F.lit(text)))
    rows = rows.union(more(external, outside, 3, " more external]:::external")).union(more(own, most, 4, " more]"))
    lines = F.array_sort(F.collect_list(F.struct("part", "key", "line")))
    body = F.transform(lines, lambda x: x["line"])
    text = F.when(F.size(body) == 0, F.array(F.lit("    A[No import graph available]"))).otherwise(F.concat(body, F.array(F.lit("    classDef external fill:#f9f"))))
    return rows.agg(F.array_join(F.concat(F.array(F.lit("flowchart TD")), text), "\n").alias("diagram"))


def entity_diagram(entities: Column, most: int = 24) -> Column:
    """An entity diagram that chains the entities in their order."""
    ids = F.transform(F.slice(T.ordered_unique(entities), F.lit(1), F.lit(most)), T.entity_id)
    box = lambda i: F.concat(F.lit("    "), i, F.lit(" {\n        string id\n    }"))
    pair = lambda i: F.concat(F.lit("    "), ids[i], F.lit(" ||--o{ "), ids[i + 1], F.lit(" : related_to"))
    chain = F.when(F.size(ids) > 1, F.transform(F.sequence(F.lit(0), F.size(ids) - 2), pair)).otherwise(F.array(F.concat(F.lit("    "), ids[0], F.lit(" ||--o{ "), ids[0], F.lit(" : self_reference"))))
    full = F.array_join(F.concat(F.array(F.lit("erDiagram")), F.transform(ids, box), chain), "\n")
    return F.when(F.size(ids) == 0, F.lit("erDiagram\n    DOMAIN_ENTITY {\n        string id\n    }")).otherwise(full)


def neighborhood_diagrams(files: DataFrame, dependencies: DataFrame, seeds: int = 6, most: int = 12) -> DataFrame:
    """``component, diagram``: a component's first files and what they import, ``most`` nodes, the rest counted."""
    rows = files.select(T.component("path").alias("component"), "path", "pos")
    first = firsts(rows, ["component"], ["pos", "path"], seeds).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("first"))
    seeded = first.select("component", F.explode(F.transform("first", lambda x: x["path"])).alias("path"))
    pairs = seeded.join(dependencies, "path", "left").where("dep is not null")
    grouped = pairs.groupBy("component").agg(F.array_sort(F.collect_set(F.struct("path", "dep"))).alias("pairs"))
    joined = first.join(grouped, "component", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<path:string,dep:string>>")))
    nodes = F.array_distinct(F.concat(F.transform("first", lambda x: x["path"]), F.transform("pairs", lambda x: x["dep"])))
    shown = F.slice(nodes, F.lit(1), F.lit(most))
    edge = F.filter("pairs", lambda p: F.array_contains(shown, p["path"]) & F.array_contains(shown, p["dep"]))
    lines = F.concat(F.transform(shown, lambda n: F.concat(F.lit("    "), T.mermaid_id(n), F.lit("["), n, F.lit("]"))), F.transform(edge, lambda p: F.concat(F.lit("    "), T.mermaid_id(p["path"]), F.lit(" --> "), T.mermaid_id(p["dep"]))))
    left = F.when(F.size(nodes) > most, F.concat(F.lit("    omitted[+"), F.size(nodes) - most, F.lit(" more]")))
    return joined.select("component", F.concat_ws("\n", F.lit("flowchart LR"), F.array_join(lines, "\n"), left).alias("diagram"))


def workflow_diagram(capability: Column, components: Column, services: Column) -> Column:
    """A sequence from the user through a capability to its components and services."""
    call = lambda to: F.concat(F.lit("    API->>"), T.mermaid_id(to), F.lit(": handle"))
    steps = F.concat(F.transform(components, call), F.transform(services, call))
    return F.concat_ws("\n", F.lit("sequenceDiagram"), F.concat(F.lit("    User->>API: "), capability), F.nullif(F.array_join(steps, "\n"), F.lit("")), F.lit("    API-->>User: result"))


# Groups that several pages use


def capability_groups(signals: DataFrame) -> DataFrame:
    """``capability, routes, evidence, components``: routes by capability; without any, one group ``platform``."""
    routes = signals.where("type = 'api_route'").select(T.capability("name").alias("capability"), "name", F.posexplode("evidence").alias("k", "cite"))
    grouped = routes.groupBy("capability").agg(
        F.array_sort(F.collect_set("name")).alias("routes"), F.array_sort(F.collect_set("cite")).alias("evidence"),
        F.array_sort(F.collect_set(T.component(T.cite_path("cite")))).alias("components"),
    )
    every = signals.agg(F.count_if(F.col("type") == "api_route").alias("n")).where("n = 0")
    none = F.array().cast("array<string>")
    return grouped.unionByName(every.select(F.lit("platform").alias("capability"), none.alias("routes"), none.alias("evidence"), none.alias("components")))


def capability_integrations(groups: DataFrame, signals: DataFrame) -> DataFrame:
    """``capability, services``: integrations that share a component with a capability; all, if it has no component.

    Integrations bear the names of rules, so all of them together are one short list.
    """
    outside = signals.where("type = 'integration'").select("name", F.explode("evidence").alias("cite")).select("name", T.component(T.cite_path("cite")).alias("component")).distinct()
    some = groups.select("capability", F.explode("components").alias("component")).join(outside, "component")
    shared = some.groupBy("capability").agg(F.array_sort(F.collect_set("name")).alias("services"))
    everything = outside.agg(F.array_sort(F.collect_set("name"))).scalar()
    joined = groups.select("capability", "components").join(shared, "capability", "left")
    none = F.array().cast("array<string>")
    return joined.select("capability", F.coalesce(F.when(F.size("components") == 0, everything), "services", none).alias("services"))


def capability_summaries(groups: DataFrame, summaries: DataFrame) -> DataFrame:
    """``capability, path``: file summaries that hold a capability's name anywhere, else those of its evidence files."""
    hay = F.lower(F.concat_ws(" ", "business_relevance", "what_it_does", "responsibility"))
    asked = groups.select("capability", F.lower("capability").alias("name"))
    found = mentions(summaries.select("path", hay.alias("hay")), "path", "hay", asked, "name")
    told = settle(found.join(asked, "name").select("capability", F.col("key").alias("path")).distinct())
    own = groups.select("capability", F.explode("evidence").alias("cite")).select("capability", T.cite_path("cite").alias("path")).distinct()
    return told.union(own.join(told.select("capability").distinct(), "capability", "left_anti"))


def public_interface(symbols: DataFrame, most: int = 20) -> DataFrame:
    """``component, interface``: the first distinct ``name (kind)`` of a component's symbols."""
    shown = F.concat("name", F.lit(" ("), "kind", F.lit(")"))
    each = symbols.groupBy(T.component("path").alias("component"), shown.alias("v")).agg(F.min(F.struct("path", "ord")).alias("at")).where("v is not null")
    rows = F.array_sort(F.collect_list(F.struct("at", "v")))
    return firsts(each, ["component"], ["at", "v"], most).groupBy("component").agg(F.transform(rows, lambda x: x["v"]).alias("interface"))


def component_links(dependencies: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Files outside a component that it depends on, and that depend on it: ``component, paths`` each."""
    rows = dependencies.select(T.component("path").alias("a"), T.component("dep").alias("b"), "path", "dep").where("a <> b")

    def cut(owner: str, shown: str) -> DataFrame:
        kept = firsts(rows.select(F.col(owner).alias("component"), F.col(shown).alias("v")).distinct(), ["component"], ["v"], most)
        return kept.groupBy("component").agg(F.array_sort(F.collect_list("v")).alias("paths"))

    return cut("a", "dep"), cut("b", "path")


# Pages


def overview_pages(system: DataFrame, files: DataFrame, symbols: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Executive summary, system context, tech stack and component graph."""
    frameworks, starts = repomap.framework_hints(files), repomap.entrypoints(files)
    langs = repomap.language_stats(files).agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "lang"))).alias("l"))
    stats = langs.select(F.transform("l", lambda x: F.concat(x["lang"], F.lit(": "), -x["col1"]))).scalar()
    first = _collected(files.select(T.cite("path", F.lit(1), F.lit(1)).alias("c")), "c", 10)
    context, graph = system_context_diagram(signals, frameworks).scalar(), component_graph_diagram(files, edges).scalar()
    fence = lambda d: F.concat(F.lit("```mermaid\n"), d, F.lit("\n```"))
    p = lambda name, title, audience, summary, sections: page_row(F.lit(f"00-overview/{name}.md"), F.lit(title), "overview", audience, summary, sections, first, tags=("overview",), confidence=F.col("confidence"))
    views = F.col("audiences")
    rows = [
        p("executive-summary", "Executive Summary", "business", F.col("executive_summary"), [("Capabilities", bullets(F.col("capabilities"), 12)), ("Business View", views["business"])]),
        p("system-context", "System Context", "business", views["business"], [("Diagram", fence(context))]),
        p("tech-stack", "Tech Stack", "technical", views["technical"], [("Languages", bullets(stats, 20)), ("Frameworks", bullets(_collected(frameworks, "label"))), ("Entry Points", bullets(_collected(starts, "path")))]),
        p("component-graph", "Component Graph", "technical", F.col("architecture_overview"), [("Diagram", fence(graph))]),
    ]
    return _union([system.select(*r) for r in rows])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def component_pages(components: DataFrame, files: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """A page for each component."""
    needs, used = component_links(dependencies)
    rows = components.join(public_interface(symbols), "component", "left")
    rows = rows.join(needs.withColumnRenamed("paths", "needs"), "component", "left").join(used.withColumnRenamed("paths", "used"), "component", "left")
    rows = rows.join(neighborhood_diagrams(files, dependencies), "component", "left")
    sections = [
        ("Capabilities", bullets(F.col("capabilities"))), ("Interface", bullets(F.col("interface"))), ("Files", bullets(F.col("files"), 24)),
        ("Dependencies", bullets(F.col("needs"))), ("Dependents", bullets(F.col("used"))), ("Data", bullets(F.col("owned_data"))),
        ("Neighborhood", F.concat(F.lit("```mermaid\n"), "diagram", F.lit("\n```"))),
    ]
    path = F.concat(F.lit("components/"), T.slug("component"), F.lit(".md"))
    return rows.select(*page_row(path, F.col("component"), "component", "technical", F.col("responsibility"), sections, F.col("citations"), tags=("component",), confidence=F.col("confidence")))


def capability_pages(signals: DataFrame, summaries: DataFrame) -> DataFrame:
    """A page and a workflow page for each capability."""
    groups = capability_groups(signals)
    told = firsts(capability_summaries(groups, summaries).distinct(), ["capability"], ["path"], 12).groupBy("capability").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    rows = groups.join(capability_integrations(groups, signals), "capability").join(told, "capability", "left")
    name = F.initcap(F.translate("capability", "-_", "  "))
    slug = T.slug("capability")
    page, flow = F.concat(F.lit("capabilities/"), slug, F.lit(".md")), F.concat(F.lit("workflows/"), slug, F.lit(".md"))
    own = [("Routes", bullets(F.col("routes"))), ("Components", bullets(F.col("components"), 12)), ("Services", bullets(F.col("services"), 10)), ("Files", bullets(F.col("paths"), 12))]
    first = F.concat(F.lit("The "), name, F.lit(" capability has "), F.size("routes"), F.lit(" routes."))
    diagram = F.concat(F.lit("```mermaid\n"), workflow_diagram(F.col("capability"), F.col("components"), F.col("services")), F.lit("\n```"))
    a = rows.select(*page_row(page, name, "capability", "business", first, own, F.col("evidence"), F.array(T.relative_link(F.concat(name, F.lit(" workflow")), page, flow)), ("capability",)))
    b = rows.select(*page_row(flow, F.concat(name, F.lit(" Workflow")), "workflow", "all", F.concat(F.lit("How requests pass through "), name, F.lit(".")), [("Sequence", diagram)], F.col("evidence"), F.array(T.relative_link(name, flow, page)), ("workflow",)))
    return a.unionByName(b)


def data_entities(signals: DataFrame, summaries: DataFrame) -> DataFrame:
    """``name``, distinct, of data models found in code or told by summaries."""
    return signals.where("type = 'data_model'").select("name").union(summaries.select(F.explode("data_touched").alias("name"))).where("name <> ''").distinct()


def domain_pages(signals: DataFrame, summaries: DataFrame) -> DataFrame:
    """Glossary, data model, external systems, risk register and setup."""
    entities = data_entities(signals, summaries)
    line = F.concat("name", F.lit(" ("), "type", F.lit("): "), F.coalesce(F.get("evidence", F.lit(0)), F.lit("")))
    listed = lambda where, most: _collected(signals.where(where).select(line.alias("v")), "v", most)
    cites = lambda where: _collected(signals.where(where).select(F.explode("evidence").alias("v")), "v", 40)
    one = signals.agg(F.count("*").alias("n")).withColumn("names", _collected(entities, "name", 60))
    glossary = "type in ('data_model', 'integration', 'config', 'messaging')"
    risk = "startswith(type, 'security') or startswith(type, 'compliance')"
    p = lambda path, title, kind, where, summary, sections: one.select(*page_row(F.lit(path), F.lit(title), kind, "all", F.lit(summary), sections, cites(where)))
    names = F.col("names")
    return _union([
        p("domain/glossary.md", "Glossary", "domain", glossary, "Terms that the code uses.", [("Terms", bullets(listed(glossary, 60), 60))]),
        p("domain/data-model.md", "Data Model", "domain", "type = 'data_model'", "Entities and their order.", [("Entities", bullets(names, 40)), ("Diagram", F.concat(F.lit("```mermaid\n"), entity_diagram(names), F.lit("\n```")))]),
        p("integrations/external-systems.md", "External Systems", "integration", "type = 'integration'", "Services that the code calls.", [("Systems", bullets(listed("type = 'integration'", 30), 30))]),
        p("risks/risk-register.md", "Risk Register", "risk", risk, "Findings that need a review.", [("Findings", bullets(listed(risk, 40), 40))]),
        p("operations/setup.md", "Setup", "operations", "type = 'config'", "What must be configured.", [("Settings", bullets(listed("type in ('config', 'scheduled_job')", 40), 40))]),
    ])


# Lenses


@dataclass
class Lens:
    """A viewpoint: guidance for prompts, rules of its own, page paths it promises, scores, and pages."""

    name: str
    guidance: str = ""
    rules: list[S.Rule] = field(default_factory=list)
    templates: tuple[str, ...] = ()
    scores: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    pages: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def _listing(path: str, title: str, prefix: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def make(signals: DataFrame, edges: DataFrame) -> DataFrame:
        own = signals.where(F.startswith("type", F.lit(prefix)))
        lines = own.agg(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), F.size("evidence")))).alias("lines"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), F.lit(1), F.lit(40)).alias("cites"))
        return lines.select(*page_row(F.lit(path), F.lit(title), "lens", "all", F.lit("Findings by kind, with their number of citations."), [("Findings", bullets(F.col("lines")))], F.col("cites"), tags=(prefix.rstrip("_"),)))

    return make


def _register_page(signals: DataFrame, edges: DataFrame) -> DataFrame:
    rows = S.opportunity_register(signals, edges.count())
    lines = rows.agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("name", F.lit(" (score "), "score", F.lit(")")).alias("line")))).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("cites"))
    return lines.select(*page_row(F.lit("opportunities/opportunity-register.md"), F.lit("Opportunity Register"), "lens", "business", F.lit("Where automation could help, best first."), [("Opportunities", bullets(F.transform("l", lambda x: x["line"])))], F.col("cites"), tags=("opportunity",)))


def _onboarding_page(signals: DataFrame, edges: DataFrame) -> DataFrame:
    counts = S.onboarding_scores(signals, edges)
    line = F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), k) for k in ("routes", "integrations", "edges")])
    return counts.select(*page_row(F.lit("onboarding/first-week.md"), F.lit("First Week"), "lens", "technical", F.lit("How much there is to learn, and where to start."), [("Size", line)], F.array().cast("array<string>"), tags=("onboarding",)))


#: Lenses by name.
LENSES = {
    "compliance": Lens("compliance", "Show what data is read, stored, logged and sent out.", S.COMPLIANCE_RULES, ("compliance/data-flow-map.md",), lambda s, e: S.lens_scores(s, "compliance_"), _listing("compliance/data-flow-map.md", "Data Flow Map", "compliance_")),
    "security": Lens("security", "Show authentication, secrets and unsafe input handling.", S.SECURITY_RULES, ("security/threat-surface.md",), lambda s, e: S.lens_scores(s, "security_"), _listing("security/threat-surface.md", "Threat Surface", "security_")),
    "onboarding": Lens("onboarding", "Explain for newcomers.", [], ("onboarding/first-week.md",), S.onboarding_scores, _onboarding_page),
    "ai_opportunity": Lens("ai_opportunity", "Look for manual decisions, queues and reconciliation.", S.OPPORTUNITY_RULES, ("opportunities/opportunity-register.md",), lambda s, e: S.opportunity_register(s, e.count()).select("name", "score"), _register_page),
}


def lens_signals(files: DataFrame, lens: Lens) -> DataFrame:
    return S.collect(S.capped(S.hits(files, lens.rules))) if lens.rules else files.sparkSession.createDataFrame([], schemas.SIGNALS)


def lens_pages(lens: Lens, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """The lens's pages, and an empty placeholder for each page it promises and does not make."""
    spark = signals.sparkSession
    made = lens.pages(signals, edges) if lens.pages else spark.createDataFrame([], schemas.PAGES)
    promised = spark.createDataFrame([(t,) for t in lens.templates], "rel_path string").join(made.select("rel_path"), "rel_path", "left_anti")
    return made.unionByName(promised.select(*page_row(F.col("rel_path"), T.page_title("rel_path"), "lens", "all", F.lit("Nothing found yet."), [], F.array().cast("array<string>"))))


def only(pages: DataFrame, names: list[str] | None) -> DataFrame:
    """The pages to emit; a filter on the path, which reaches down to what the pages are made of."""
    return pages if names is None else pages.where(F.col("rel_path").isin(names))


@dataclass
class Known:
    """What a build has made before its pages."""

    signals: DataFrame
    edges: DataFrame
    summaries: DataFrame
    components: DataFrame
    system: DataFrame


def _without_model(files: DataFrame, symbols: DataFrame) -> Known:
    found = settle(S.detect_signals(files, symbols))
    edges = settle(graph.build_edges(files, symbols, repomap.resolve_imports(files, symbols)))
    told = settle(summarize.fallback_summaries(files, symbols))
    parts = settle(summarize.reduce_components(told, found))
    return Known(found, edges, told, parts, summarize.reduce_system(parts, files, symbols, repomap.framework_hints(files), repomap.entrypoints(files)))


def build_pages(files: DataFrame, symbols: DataFrame, lenses: list[Lens] | None = None, only_pages: list[str] | None = None, known: Known | None = None) -> DataFrame:
    """All pages of a build: overview, components, capabilities, domain and lenses (all known ones, unless given).

    With ``only_pages`` just those of these paths; builders that none of them can come from are not asked. Without
    ``known``, summaries are the fallback's.
    """
    wanted = lambda *prefixes: only_pages is None or any(p.startswith(prefixes) for p in only_pages)
    lenses = list(LENSES.values()) if lenses is None else lenses
    files, symbols = settle(files), settle(symbols)
    k = known or _without_model(files, symbols)
    out = [files.sparkSession.createDataFrame([], schemas.PAGES)]
    if wanted("00-overview/"):
        out.append(overview_pages(settle(k.system), files, symbols, k.signals, k.edges))
    if wanted("components/"):
        out.append(component_pages(k.components, files, symbols, graph.file_dependencies(k.edges)))
    if wanted("capabilities/", "workflows/"):
        out.append(capability_pages(k.signals, k.summaries))
    if wanted("domain/", "integrations/", "risks/", "operations/"):
        out.append(domain_pages(k.signals, k.summaries))
    for lens in lenses:
        if wanted(*lens.templates):
            out.append(lens_pages(lens, k.signals.unionByName(lens_signals(files, lens)), k.edges))
    return only(_union(out), only_pages)
