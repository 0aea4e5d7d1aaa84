"""A whole build: summaries by model, cache and fallback within a budget, gated, then pages, page map, manifest and log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.lineage import settle
from loam.operators import graph, incremental, lint, pages, repomap, summarize
from loam.operators import signals as S
from loam.sources import files as sources
from loam.sources import sinks


@dataclass
class Build:
    """What a build made: its inputs, the summaries of all levels, pages as rows, their page map, and the budget's state.

    ``gated`` says that the model's words were dropped, since the system's confidence was low.
    """

    files: DataFrame
    symbols: DataFrame
    signals: DataFrame
    edges: DataFrame
    summaries: DataFrame
    components: DataFrame
    system: DataFrame
    pages: DataFrame
    pagemap: DataFrame
    budget: summarize.Budget
    gated: bool


def generate(
    files: DataFrame, symbols: DataFrame, model: Callable | None = None, cache: DataFrame | None = None, strict: bool = False,
    budget: summarize.Budget | None = None, lenses: list[pages.Lens] | None = None, only_pages: list[str] | None = None, previous: DataFrame | None = None,
) -> Build:
    """Everything a run makes of ``files`` and ``symbols``.

    ``model`` takes the name of a column of prompts and gives a column of JSON answers. Files are asked about first, in
    their order, then components, then the system, as long as ``budget`` lasts; what is in ``cache`` by content is not
    asked about, and what gets no answer keeps the fallback. With ``strict``, answers count only if the system's
    confidence is not low. The page map keeps the locks of ``previous``.
    """
    budget = budget or summarize.Budget()
    files, symbols = settle(files), settle(symbols)
    found = settle(S.detect_signals(files, symbols))
    edges = settle(graph.build_edges(files, symbols, repomap.resolve_imports(files, symbols)))
    guidance = " ".join(lens.guidance for lens in lenses or [] if lens.guidance)
    prompts = summarize.file_prompts(files, symbols, found, graph.neighbor_context(edges, symbols), guidance)

    def levels(model: Callable | None, cache: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        told = settle(summarize.summarize_files(files, symbols, prompts, model, cache, budget))
        parts = summarize.reduce_components(told, found)
        if model is not None:
            parts = settle(parts)
            parts = summarize.summarize_components(parts, summarize.component_prompts(parts, told), model, budget)
        parts = settle(parts)
        system = settle(summarize.reduce_system(parts, files, symbols, repomap.framework_hints(files), repomap.entrypoints(files)))
        if model is not None:
            system = settle(summarize.summarize_system(system, summarize.system_prompt(parts), model, budget))
        return told, parts, system

    told, parts, system = levels(model, cache)
    gated = bool(strict and system.where("confidence = 'low'").count())
    shown = levels(None, None) if gated else (told, parts, system)
    made = settle(pages.build_pages(files, symbols, lenses, only_pages, pages.Known(found, edges, *shown)))
    text = made.select(F.col("rel_path").alias("page"), sinks.render_page().alias("text"))
    pagemap = incremental.build_pagemap(lint.page_citations(text), symbols, files, previous)
    return Build(files, symbols, found, edges, told, *shown[1:], made, pagemap, budget, gated)


def write_build(built: Build, root: str, source_root: str, at: str) -> None:
    """Write a build under ``root``: pages, the guide for agents, page map, manifest, new summaries, and a line of the log.

    ``at`` is the run's time, a timestamp as text. Summaries join the cache by content, each once.
    """
    spark = built.files.sparkSession
    sinks.write_pages(built.pages.unionByName(sinks.agents_page(spark)), f"{root}/pages")
    sinks.write_pagemap(built.pagemap, f"{root}/pagemap")
    sinks.write_manifest(built.files, f"{root}/manifest", source_root)
    known = sources.load_summaries(spark, f"{root}/summaries")
    fresh = built.summaries.select(*known.columns).dropDuplicates(["source_hash"]).join(known.select("source_hash"), "source_hash", "left_anti").select(*known.columns)
    sinks.put_summaries(settle(fresh), f"{root}/summaries")
    detail = F.concat(F.count("*").cast("string"), F.lit(" pages" + (", summaries gated" if built.gated else "")))
    sinks.append_log(built.pages.agg(detail.alias("detail")).select(F.lit(at).cast("timestamp").alias("ts"), F.lit("generate").alias("event"), "detail"), f"{root}/log")
