"""Map-reduce summaries: files, then components, then the system. Without a model the templates here are the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import firsts, running, settle

SCHEMA_VERSION = 2
LEVELS = ["low", "medium", "high"]
#: Caps of neighbour lists (imports, dependents, calls), tried in turn until the block fits. Fixed values.
CAPS_IMPORTS, CAPS_DEPENDENTS, CAPS_CALLS = (12, 8, 5, 3, 2), (12, 8, 5, 3, 2), (8, 6, 4, 3, 2)

_none = lambda: F.array().cast("array<string>")


def _first_seen(rows: DataFrame, group: list[str], most: dict[str, int]) -> DataFrame:
    """For each group and list column its first distinct strings in file order, trimmed, as many as ``most`` says.

    Strings are ranked as rows and cut before they are gathered, so a group's size does not matter.
    """
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(n).alias("most"), F.col(c).alias("list")) for c, n in most.items()]))
    each = rows.select(*group, "pos", lists.alias("l")).select(*group, "pos", "l.kind", "l.most", F.posexplode("l.list").alias("k", "v"))
    each = each.withColumn("v", F.trim("v")).where("v <> ''").groupBy(*group, "kind", "most", "v").agg(F.min(F.struct("pos", "k")).alias("at"))
    order = Window.partitionBy(*group, "kind").orderBy("at", "v")
    kept = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(most.values())).where("r <= most")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("r", "v")))), lambda x: x["v"]).alias(c)
    return kept.groupBy(*group).agg(*map(listed, most))


def file_symbols(symbols: DataFrame, most: int = 12) -> DataFrame:
    """``path, names`` of a file's first symbols."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "name")))
    kept = firsts(symbols.select("path", "ord", "name"), ["path"], ["ord", "name"], most)
    return kept.groupBy("path").agg(F.transform(rows, lambda x: x["name"]).alias("names"))


def file_signals(signals: DataFrame) -> DataFrame:
    """``path, names`` of the signals that a file shows."""
    rows = signals.select("name", F.explode("evidence").alias("cite")).select("name", T.cite_path("cite").alias("path"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def fallback_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The summary that a file gets without a model: low confidence, its first line cited, up to 8 symbol names."""
    named = files.select("path", "hash", "pos").join(file_symbols(symbols, 8), "path", "left")
    return named.select(
        "path", F.lit("Holds part of this component's implementation.").alias("responsibility"),
        F.lit("Supports the capabilities that the code's structure shows.").alias("business_relevance"), F.lit("low").alias("confidence"),
        F.col("hash").alias("source_hash"), F.lit("").alias("what_it_does"), F.coalesce("names", _none()).alias("key_symbols"),
        F.array(T.cite("path", F.lit(1), F.lit(1))).alias("citations"), _none().alias("interfaces"), _none().alias("dependencies"),
        _none().alias("data_touched"), _none().alias("key_behaviors"), F.lit(SCHEMA_VERSION).alias("schema_version"), "pos",
    )


def neighbor_block(context: DataFrame, budget: int = 600) -> DataFrame:
    """``path, block``: imports, dependents and calls under the first caps that stay within ``budget`` tokens.

    Caps are tried in order, those of calls first, then of dependents, then of imports; a block that fits under none
    of them says ``(trimmed)``, and a file without neighbours has none.
    """
    held = {c: F.coalesce(c, _none()) for c in ("imports", "dependents", "calls")}
    shown = lambda c, n: F.when(F.size(held[c]) == 0, "(none)").otherwise(F.array_join(F.slice(held[c], F.lit(1), n), ", "))
    block = lambda a, b, c: F.concat(F.lit("Graph neighbors:\n- Imports: "), a, F.lit("\n- Depended on by (1-hop): "), b, F.lit("\n- Calls (top symbols): "), c)
    caps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in CAPS_IMPORTS for b in CAPS_DEPENDENTS for c in CAPS_CALLS])
    text = lambda t: block(shown("imports", t["a"]), shown("dependents", t["b"]), shown("calls", t["c"]))
    fits = lambda t: T.token_estimate(F.concat(F.lit("user\n"), text(t))) <= budget
    first = F.aggregate(caps, F.lit(None).cast("string"), lambda found, t: F.when(found.isNotNull(), found).when(fits(t), text(t)))
    some = F.size(F.concat(*held.values())) > 0
    trimmed = block(F.lit("(trimmed)"), F.lit("(trimmed)"), F.lit("(trimmed)"))
    return context.select("path", F.when(some, F.coalesce(first, trimmed)).otherwise("").alias("block"))


def file_prompts(files: DataFrame, symbols: DataFrame, signals: DataFrame, context: DataFrame | None = None, guidance: str = "") -> DataFrame:
    """``path, prompt``: what a model is asked about a file; 12 symbols and 12,000 characters at most."""
    named = file_symbols(symbols).withColumnRenamed("names", "symbol_names")
    shown = file_signals(signals).withColumnRenamed("names", "signal_names")
    rows = files.join(named, "path", "left").join(shown, "path", "left")
    rows = rows.join(neighbor_block(context), "path", "left") if context is not None else rows.withColumn("block", F.lit(None).cast("string"))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(F.coalesce(c, _none()), ", "), F.lit("")), F.lit("(none)"))
    head = "Describe this source file as JSON. Ground every claim in path:Lx-Ly citations; say unknown where the code does not tell."
    prompt = F.concat_ws(
        "\n", F.lit(head + (f"\nGuidance: {guidance}" if guidance else "")), F.concat(F.lit("Path: "), "path"), F.concat(F.lit("Language: "), "lang"),
        F.concat(F.lit("Symbols: "), listed(F.col("symbol_names"))), F.concat(F.lit("Signals: "), listed(F.col("signal_names"))), F.col("block"),
        F.lit("Content:"), F.left("text", F.lit(12_000)),
    )
    return rows.select("path", prompt.alias("prompt"))


#: What a model is asked once more after an answer without a JSON object.
REPAIR = "Return valid JSON only with exactly these keys: "


def answers(prompts: DataFrame, key: str, model: Callable, fields: list[str]) -> DataFrame:
    """``key, json``: the JSON object in the model's answer to each prompt; where there is none, it is asked once more.

    Prompts whose second answer has none either give no row. Answers are kept, so that no prompt is sent again.
    """
    valid = F.try_parse_json(T.json_object("raw")).isNotNull()
    told = settle(prompts.select(key, "prompt", model("prompt").alias("raw")))
    again = F.concat("prompt", F.lit("\n\nYour answer was:\n"), F.coalesce("raw", F.lit("")), F.lit("\n\n" + REPAIR + ", ".join(fields) + "."))
    repaired = settle(told.where(~F.coalesce(valid, F.lit(False))).select(key, again.alias("prompt")).select(key, model("prompt").alias("raw")))
    return told.select(key, "raw").unionByName(repaired).where(valid).select(key, T.json_object("raw").alias("json"))


def _said(schema: dict[str, str]) -> Column:
    """An answer's fields: texts and list items trimmed, empty ones null, list items each once; confidence one of three."""
    ddl = ", ".join(f"{f} {t}" for f, t in schema.items())
    raw = F.from_json("json", ddl)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    items = lambda c: F.when(F.size(T.ordered_unique(c)) > 0, T.ordered_unique(c))
    level = lambda c: F.when(F.lower(F.trim(c)).isin(LEVELS), F.lower(F.trim(c))).otherwise("medium")
    clean = {f: level(raw[f]) if f == "confidence" else items(raw[f]) if t == "array<string>" else text(raw[f]) if t == "string" else raw[f] for f, t in schema.items()}
    return F.struct(*[v.alias(f) for f, v in clean.items()])


def _kinds(df: DataFrame, fields: list[str]) -> dict[str, str]:
    return {f: df.schema[f].dataType.simpleString() for f in fields}


def call_cost(prompt: Column | str, reserve: int = 0) -> Column:
    """What a call is expected to use: the prompt's estimate and ``reserve`` tokens for the answer."""
    return (T.token_estimate(F.concat(F.lit("user\n"), T.c(prompt))) + F.lit(reserve)).cast("long")


def admit(prompts: DataFrame, order: list[str], limit: int | None, reserve: int = 0) -> DataFrame:
    """``prompts`` (with ``prompt``) with ``cost`` and ``admitted``: the first ones in ``order`` whose costs add up to ``limit`` at most.

    ``order`` tells all prompts apart, so the same ones are admitted however they are laid out, and no call is sent that
    could pass the limit; without a limit all are.
    """
    priced = prompts.withColumn("cost", call_cost("prompt", reserve))
    if limit is None:
        return priced.withColumn("admitted", F.lit(True))
    return running(priced, order, "cost", "_total").withColumn("admitted", F.col("_total") <= limit).drop("_total")


@dataclass
class Budget:
    """Tokens that the stages of a run may use together; each stage sends what its predecessors have left room for.

    ``refused`` holds, by stage, the keys of prompts that took the fallback for want of tokens.
    """

    limit: int | None = None
    reserve: int = 0
    spent: int = 0
    refused: dict[str, DataFrame] = field(default_factory=dict)

    def send(self, stage: str, prompts: DataFrame, key: str, order: list[str]) -> DataFrame:
        """The prompts that may be sent; their costs count as spent."""
        if self.limit is None:
            return prompts
        told = settle(admit(prompts, order, max(0, self.limit - self.spent), self.reserve))
        self.spent += told.where("admitted").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
        self.refused[stage] = told.where("not admitted").select(key, "cost")
        return told.where("admitted").drop("cost", "admitted")


def summarize_files(files: DataFrame, symbols: DataFrame, prompts: DataFrame, model: Callable | None = None, cache: DataFrame | None = None, budget: Budget | None = None) -> DataFrame:
    """A summary of every file: from the cache by content, else from ``model`` (an injected UDF of the prompt to JSON),
    else the fallback. Files of equal content are asked about once, by the first one's prompt. Citations without lines
    are dropped from an answer; if none is left of some, line 1 is cited. With a ``budget``, files are asked about in
    the order of ``pos`` as long as it lasts."""
    base = fallback_summaries(files, symbols)
    fields = [c for c in base.columns if c not in ("path", "source_hash", "schema_version", "pos")]
    kinds = _kinds(base, fields)
    none = F.lit(None).cast("struct<" + ",".join(f"{f}:{t}" for f, t in kinds.items()) + ">")
    if cache is not None:
        hits = cache.where(F.col("schema_version") == SCHEMA_VERSION).dropDuplicates(["source_hash"]).select("source_hash", F.struct(*fields).alias("hit"))
        base = base.join(hits, "source_hash", "left")
    else:
        base = base.withColumn("hit", none)
    if model is not None:
        asked = prompts.join(base.where("hit is null").select("path", "source_hash", "pos"), "path").groupBy("source_hash").agg(F.min_by("prompt", "pos").alias("prompt"), F.min("pos").alias("pos"))
        asked = budget.send("files", asked, "source_hash", ["pos", "source_hash"]) if budget else asked
        told = answers(asked, "source_hash", model, fields).select("source_hash", _said(kinds).alias("said"))
        base = base.join(told, "source_hash", "left")
    else:
        base = base.withColumn("said", none)
    cited = F.filter("said.citations", lambda x: F.contains(x, F.lit(":L")))
    known = {f: F.col(f"said.{f}") for f in fields} | {"citations": F.when(F.size(cited) > 0, cited)}
    level = lambda c: F.when(c.isin(LEVELS), c)
    picked = {f: F.coalesce(level(F.col(f"hit.{f}")) if f == "confidence" else F.col(f"hit.{f}"), known[f], F.col(f)).alias(f) for f in fields}
    return base.select("path", *picked.values(), "source_hash", "schema_version", "pos")


def _retold(rows: DataFrame, key: str, prompts: DataFrame, model: Callable, fields: list[str]) -> DataFrame:
    told = answers(prompts, key, model, fields).select(key, _said(_kinds(rows, fields)).alias("said"))
    picked = [F.coalesce(f"said.{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return rows.join(told, key, "left").select(*picked)


def summarize_components(components: DataFrame, prompts: DataFrame, model: Callable, budget: Budget | None = None) -> DataFrame:
    """``components`` in the model's words where it answers ``prompts`` (``component, prompt``) and a ``budget`` lasts; else as they are."""
    prompts = budget.send("components", prompts, "component", ["component"]) if budget else prompts
    fields = ["responsibility", "capabilities", "citations", "confidence", "interfaces", "dependencies", "owned_data"]
    return _retold(components, "component", prompts, model, fields)


def summarize_system(system: DataFrame, prompt: DataFrame, model: Callable, budget: Budget | None = None) -> DataFrame:
    """The one row of ``system`` in the model's words where it answers ``prompt`` and a ``budget`` lasts; else as it is."""
    prompt = budget.send("system", prompt, "prompt", ["prompt"]) if budget else prompt
    fields = ["executive_summary", "capabilities", "audiences", "confidence", "architecture_overview"]
    one = F.lit(0).alias("one")
    return _retold(system.select("*", one), "one", prompt.select(one, "prompt"), model, fields).drop("one")


def merged_confidence(column: str = "confidence") -> Column:
    """The least of low, medium and high over a group; medium if there is none."""
    held = lambda level: F.coalesce(F.bool_or(F.col(column) == level), F.lit(False))
    return F.when(held("low"), "low").when(held("medium"), "medium").when(held("high"), "high").otherwise("medium")


def capabilities_by_component(signals: DataFrame) -> DataFrame:
    """``component, capabilities``: labels of the signals that a component shows, sorted."""
    label = F.when(F.col("type") == "api_route", T.capability_label("name")).otherwise(F.trim("name"))
    rows = signals.select(label.alias("label"), F.explode("evidence").alias("cite")).where("label <> ''")
    return rows.groupBy(T.component(T.cite_path("cite")).alias("component")).agg(F.array_sort(F.collect_set("label")).alias("capabilities"))


def reduce_components(summaries: DataFrame, signals: DataFrame) -> DataFrame:
    """One row a component: capabilities, first citations, interfaces, dependencies and data, least confidence."""
    owner = T.component("path").alias("component")
    grouped = summaries.groupBy(owner).agg(F.array_sort(F.collect_list("path")).alias("files"), merged_confidence().alias("confidence"), F.min("pos").alias("pos"))
    lists = {"citations": F.col("citations"), "interfaces": F.col("interfaces"), "dependencies": F.col("dependencies"), "owned_data": F.col("data_touched"), "told": F.array("responsibility")}
    firsts = _first_seen(summaries.select(owner, "pos", *[v.alias(k) for k, v in lists.items()]), ["component"], {**dict.fromkeys(lists, 24), "told": 2})
    grouped = grouped.join(firsts, "component", "left").select("component", "files", "confidence", "pos", *[F.coalesce(k, _none()).alias(k) for k in lists])
    two = F.when(F.size("told") == 0, "Responsibilities follow from the grouped files.").otherwise(F.array_join(F.slice("told", F.lit(1), F.lit(2)), " Also: "))
    named = grouped.join(capabilities_by_component(signals), "component", "left")
    return named.select(
        "component", two.alias("responsibility"), F.coalesce("capabilities", F.array(F.lit("core repository behavior"))).alias("capabilities"), "files", "citations",
        "confidence", "interfaces", "dependencies", "owned_data", "pos",
    )


def reduce_system(components: DataFrame, files: DataFrame, symbols: DataFrame, frameworks: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """One row for the whole corpus: summary, capabilities, two views, least confidence."""
    labels = F.array_join(F.array_sort(F.collect_list("label")), ", ")
    counts = [files.agg(F.count("*")).scalar(), symbols.agg(F.count("*")).scalar(), entrypoints.agg(F.count("*")).scalar(), frameworks.select("label").distinct().orderBy("label").limit(5).agg(labels).scalar()]
    seen = components.select("pos", F.posexplode("capabilities").alias("k", "v")).groupBy(F.trim("v").alias("v")).agg(F.min(F.struct("pos", "k")).alias("at")).where("v <> ''")
    told = seen.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).scalar()  # labels, not files
    row = components.agg(merged_confidence().alias("confidence"), F.count("*").alias("n")).withColumn("capabilities", told)
    row = row.select("capabilities", "confidence", "n", *[c.alias(k) for c, k in zip(counts, ("files", "symbols", "entrypoints", "frameworks"))])
    row = row.withColumn("capabilities", F.when(F.size("capabilities") == 0, F.array(F.lit("platform operations"))).otherwise(F.col("capabilities")))
    summary = F.concat(F.lit("Covers "), "files", F.lit(" files in "), "n", F.lit(" components with "), "symbols", F.lit(" symbols."))
    business = F.concat(F.lit("Main capabilities: "), F.array_join(F.slice("capabilities", F.lit(1), F.lit(6)), ", "), F.lit("."))
    stack = F.coalesce(F.nullif("frameworks", F.lit("")), F.lit("none detected"))
    technical = F.concat(F.lit("Frameworks: "), stack, F.lit(". Entry points: "), "entrypoints", F.lit("."))
    return row.select(
        summary.alias("executive_summary"), "capabilities", F.create_map(F.lit("business"), business, F.lit("technical"), technical).alias("audiences"),
        "confidence", technical.alias("architecture_overview"),
    )


def component_prompts(components: DataFrame, summaries: DataFrame, files: int = 14, cites: int = 3, data: int = 4) -> DataFrame:
    """``component, prompt`` from the first files' summaries."""
    line = F.concat(
        F.lit("- "), "path", F.lit(": "), "responsibility", F.lit(" ["), F.array_join(F.slice("citations", F.lit(1), F.lit(cites)), ", "), F.lit("] data: "),
        F.array_join(F.slice("data_touched", F.lit(1), F.lit(data)), ", "),
    )
    kept = firsts(summaries.select(T.component("path").alias("component"), "pos", line.alias("line")), ["component"], ["pos", "line"], files)
    lines = kept.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rows = components.select("component", "capabilities").join(lines, "component")
    return rows.select("component", F.concat(F.lit("Summarise this component as JSON: "), "component", F.lit("\nCapabilities: "), F.array_join("capabilities", ", "), F.lit("\n"), body).alias("prompt"))


def system_prompt(components: DataFrame, most: int = 16, cites: int = 2, capabilities: int = 5) -> DataFrame:
    """``prompt`` from the first components."""
    line = F.concat(
        F.lit("- "), "component", F.lit(": "), "responsibility", F.lit(" {"), F.array_join(F.slice("capabilities", F.lit(1), F.lit(capabilities)), ", "), F.lit("} ["),
        F.array_join(F.slice("citations", F.lit(1), F.lit(cites)), ", "), F.lit("]"),
    )
    rows = components.orderBy("pos").limit(most).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return rows.select(F.concat(F.lit("Summarise this system as JSON.\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def strict_gate(system: DataFrame) -> Column:
    """Whether summaries may be used at all: not when the system's confidence is low."""
    return system.select(F.col("confidence") != "low").scalar()


def token_plan(prompts: DataFrame, cache: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``prompts, tokens`` that a run would send, files with a cached summary left out."""
    if cache is not None and files is not None:
        hits = files.join(cache.where(F.col("schema_version") == SCHEMA_VERSION).select(F.col("source_hash").alias("hash")), "hash", "left_semi")
        prompts = prompts.join(hits.select("path"), "path", "left_anti")
    return prompts.agg(F.count("*").alias("prompts"), F.coalesce(F.sum(T.token_estimate(F.concat(F.lit("user\n"), "prompt"))), F.lit(0)).cast("long").alias("tokens"))


def run_plan(files: DataFrame, components: DataFrame, system: DataFrame, budget: int | None = None) -> DataFrame:
    """``level, prompts, tokens, remaining`` of a dry run: the prompts of all three levels, and the budget left after each."""
    order = {"files": 0, "components": 1, "system": 2}
    parts = [token_plan(p).select(F.lit(order[n]).alias("at"), F.lit(n).alias("level"), "prompts", "tokens") for n, p in (("files", files), ("components", components), ("system", system))]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    used = F.sum("tokens").over(Window.orderBy("at"))  # three rows
    left = F.lit(budget).cast("long") - used if budget is not None else F.lit(None).cast("long")
    return rows.select("level", "prompts", "tokens", left.alias("remaining"))


def usage_totals(usage: DataFrame, limit: int | None = None) -> DataFrame:
    """``requests, prompt_tokens, completion_tokens, total_tokens, exceeded`` of usage rows; exceeded is strictly above.

    Missing or negative counts are 0, and a missing total is the sum of the other two.
    """
    clean = lambda c: F.greatest(F.coalesce(F.col(c).try_cast("long"), F.lit(0)), F.lit(0))
    sums = usage.agg(F.count("*").alias("requests"), F.coalesce(F.sum(clean("prompt_tokens")), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(clean("completion_tokens")), F.lit(0)).alias("completion_tokens"))
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return sums.select("*", total.alias("total_tokens"), (total > limit if limit is not None else F.lit(False)).alias("exceeded"))
