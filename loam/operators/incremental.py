"""Incremental refresh: what changed between two manifests, and which pages that touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import settle
from loam.operators.spans import overlapping
from loam.sources.sinks import mark_contradiction


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: added, removed or changed between two manifests (``path, hash``)."""
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def affected_pages(pagemap: DataFrame, changed: DataFrame) -> DataFrame:
    """``page`` of the pages made from a changed file (``path``), by their source files or their hashes."""
    used = pagemap.select("page", F.explode(F.array_union("source_files", F.map_keys("file_hashes"))).alias("path"))
    return used.join(changed.select("path"), "path", "left_semi").select("page").distinct()


def predicted_pages(diff: DataFrame, signals: DataFrame) -> DataFrame:
    """``page`` of the pages that changed files should touch: components, capabilities, glossary, integrations, overview."""
    parts = diff.select(F.concat(F.lit("components/"), T.slug(T.component("path")), F.lit(".md")).alias("page"))
    fresh = diff.where("change <> 'removed'").select("path")
    shown = signals.select("type", "name", F.explode("evidence").alias("cite")).where(F.contains("cite", F.lit(":L")))
    touched = shown.select("type", "name", T.cite_path("cite").alias("path")).join(fresh, "path", "left_semi")
    routes = touched.where("type = 'api_route'").select(F.concat(F.lit("capabilities/"), T.slug(T.capability("name")), F.lit(".md")))
    words = touched.where(F.col("type").isin("data_model", "integration", "config", "messaging")).select(F.lit("domain/glossary.md"))
    outside = touched.where("type = 'integration'").select(F.lit("integrations/external-systems.md"))
    overview = F.array(*map(F.lit, ["00-overview/tech-stack.md", "00-overview/component-graph.md", "00-overview/executive-summary.md"]))
    moved = diff.where("change <> 'changed'").limit(1).select(F.explode(overview))
    return parts.union(routes).union(words).union(outside).union(moved).distinct()


def citation_symbols(cited: DataFrame, symbols: DataFrame) -> DataFrame:
    """``page, symbol_id``: symbols whose lines a citation overlaps, however many of both a file has."""
    s = symbols.select("path", F.col("id").alias("symbol_id"), "start_line", "end_line")
    spans = cited.select("path", "page", "start", "end").distinct()
    return overlapping(spans, s, "path", ("start", "end"), ("start_line", "end_line")).select("page", "symbol_id").distinct()


def build_pagemap(cited: DataFrame, symbols: DataFrame, files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The page map of all pages with citations; locks and, where none are found now, symbols stay from ``previous``."""
    paths = cited.select("page", "path").distinct()
    sources = paths.groupBy("page").agg(F.array_sort(F.collect_set("path")).alias("source_files"))
    named = citation_symbols(cited, symbols).groupBy("page").agg(F.array_sort(F.collect_set("symbol_id")).alias("source_symbols"))
    held = paths.join(files.select("path", "hash"), "path").groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "hash")))).alias("file_hashes"))
    out = sources.join(named, "page", "left").join(held, "page", "left")
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    if previous is None:
        return out.select("page", "source_files", F.coalesce("source_symbols", none).alias("source_symbols"), F.coalesce("file_hashes", no_map).alias("file_hashes"), F.lit(False).alias("human_edited"))
    old = previous.select("page", F.col("source_symbols").alias("old"), F.col("human_edited").alias("locked"))
    return out.join(old, "page", "left").select(
        "page", "source_files", F.coalesce("source_symbols", "old", none).alias("source_symbols"), F.coalesce("file_hashes", no_map).alias("file_hashes"),
        F.coalesce("locked", F.lit(False)).alias("human_edited"),
    )


def locked_pages(pagemap: DataFrame, pages: DataFrame, marker: str = "<!-- human-edited -->") -> DataFrame:
    """``page`` of the pages not to be overwritten, by the page map or by a marker in the page."""
    return pagemap.where("human_edited").select("page").union(pages.where(F.contains("text", F.lit(marker))).select("page")).distinct()


def plan_refresh(affected: DataFrame, locked: DataFrame) -> DataFrame:
    """``page, action``: regenerate, or propose beside a locked page."""
    marked = affected.join(locked.withColumn("locked", F.lit(True)), "page", "left")
    return marked.select("page", F.when(F.col("locked"), "propose").otherwise("regenerate").alias("action"))


def stale_pages(planned: DataFrame, emitted: DataFrame) -> DataFrame:
    """Pages to regenerate that were not emitted any more."""
    return planned.where("action = 'regenerate'").select("page").join(emitted.select("page"), "page", "left_anti")


def changed_summaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """``page`` where both versions have a summary and they differ."""
    a, b = before.select("page", T.summary_section("text").alias("was")), after.select("page", T.summary_section("text").alias("now"))
    return a.join(b, "page").where("was <> '' and now <> '' and was <> now").select("page")


def update_report(diff: DataFrame, affected: DataFrame, planned: DataFrame, stale: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``item, names``: the run's report, a row for each list."""
    rows = diff.select("change", "path").union(affected.select(F.lit("affected_pages"), "page"))
    rows = rows.union(planned.select(F.when(F.col("action") == "propose", "proposed_pages").otherwise("regenerated_pages"), "page"))
    rows = rows.union(stale.select(F.lit("stale_removed_pages"), "page")).union(contradictions.select(F.lit("contradictions"), "page"))
    return rows.groupBy(F.col("change").alias("item")).agg(F.array_sort(F.collect_set("path")).alias("names"))


def proposed_path(page: Column | str) -> Column:
    """Where a proposal for a locked page goes, beside it."""
    return F.regexp_replace(T.c(page), r"\.md$", ".proposed.md")


@dataclass
class Update:
    """What an update does: the plan, the whole page table afterwards, pages that now say something else, the report."""

    planned: DataFrame
    pages: DataFrame
    contradictions: DataFrame
    report: DataFrame


def update_pages(old: DataFrame, new: DataFrame, pagemap: DataFrame, current: DataFrame, signals: DataFrame, build: Callable[[DataFrame], DataFrame]) -> Update:
    """From two manifests to the pages (``page, text``): affected ones are built anew, and only those.

    ``build`` makes ``page, text`` of the wanted pages (``page``). Locked pages stay, with a proposal beside them; pages
    that are not made any more go; pages whose summary changes are marked.
    """
    diff = settle(manifest_diff(old, new))
    affected = affected_pages(pagemap, diff).union(predicted_pages(diff, signals)).distinct()
    planned = settle(plan_refresh(affected, locked_pages(pagemap, current)))
    made = settle(build(planned.select("page")).join(planned, "page").select("page", "text", "action"))
    fresh, proposed = made.where("action = 'regenerate'").select("page", "text"), made.where("action = 'propose'").select(proposed_path("page").alias("page"), "text")
    stale = stale_pages(planned, fresh).join(current.select("page"), "page", "left_semi")
    contradicting = changed_summaries(current, fresh)
    marked = fresh.join(contradicting.withColumn("changed", F.lit(True)), "page", "left")
    marked = marked.select("page", F.when(F.col("changed"), mark_contradiction("text")).otherwise(F.col("text")).alias("text"))
    gone = fresh.select("page").union(proposed.select("page")).union(stale)
    pages = current.select("page", "text").join(gone, "page", "left_anti").unionByName(marked).unionByName(proposed)
    return Update(planned, pages, contradicting, update_report(diff, affected, planned, stale, contradicting))
