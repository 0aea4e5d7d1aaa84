"""Corpus health: citations that do not hold, links that lead nowhere, pages that nothing links to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import placed

#: Pages that need no inbound link. Fixed values.
ROOTS = ["index.md", "log.md", "00-overview/executive-summary.md"]


def page_citations(pages: DataFrame) -> DataFrame:
    """``page, cite, path, start, end`` of every citation in every page (``page, text``)."""
    rows = pages.select("page", F.explode(T.citations("text")).alias("cite"))
    span = T.cite_span("cite")
    return rows.select("page", "cite", span["path"].alias("path"), span["start"].alias("start"), span["end"].alias("end"))


def check_citations(cited: DataFrame, files: DataFrame) -> DataFrame:
    """``cited`` with ``status``: placeholder (lines 1 to 1), unresolved (no such file), stale (beyond its end) or ok."""
    lines = files.select("path", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("lines"))
    first = (F.col("start") == 1) & (F.col("end") == 1)
    status = F.when(first, "placeholder").when(F.col("lines").isNull(), "unresolved").when(F.col("end") > F.col("lines"), "stale").otherwise("ok")
    return cited.join(lines, "path", "left").select(*cited.columns, status.alias("status"))


def page_links(pages: DataFrame, strict_paths: bool = False) -> DataFrame:
    """``page, link, target``: each Markdown link with the page it means, null if there is none.

    A link counts from the root or from its page's folder. ``..`` parts are resolved, unless ``strict_paths``.
    """
    rows = pages.select("page", F.explode(T.links("text")).alias("link"))
    parent = F.regexp_replace("page", r"/?[^/]*$", "")
    joined = F.when(parent == "", F.col("link")).otherwise(F.concat(parent, F.lit("/"), "link"))
    rows = rows.withColumn("beside", joined if strict_paths else T.normalize_path(joined))
    names = pages.select(F.col("page").alias("name")).distinct()
    found = rows.join(names.withColumnRenamed("name", "a"), F.col("link") == F.col("a"), "left")
    found = found.join(names.withColumnRenamed("name", "b"), F.col("beside") == F.col("b"), "left")
    return found.select("page", "link", F.coalesce("a", "b").alias("target"))


def broken_links(linked: DataFrame) -> DataFrame:
    return linked.where("target is null").select("page", "link")


def inbound(linked: DataFrame) -> DataFrame:
    """``page, n``: how many links lead to each page that any leads to."""
    return linked.where("target is not null").groupBy(F.col("target").alias("page")).agg(F.count("*").alias("n"))


def orphans(pages: DataFrame, linked: DataFrame, roots: list[str] = ROOTS) -> DataFrame:
    return pages.where(~F.col("page").isin(roots)).select("page").join(inbound(linked), "page", "left_anti")


def missing_citations(pages: DataFrame) -> DataFrame:
    """Pages that have a section of sources and cite nothing."""
    return pages.where(F.contains("text", F.lit("## Sources")) & (F.size(T.citations("text")) == 0)).select("page")


def lint_findings(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``kind, item``: the distinct findings, a row each."""
    checked, linked = check_citations(page_citations(pages), files), page_links(pages)
    found = checked.where("status <> 'ok'").select(F.concat("status", F.lit("_citations")).alias("kind"), F.concat("page", F.lit(": "), "cite").alias("item"))
    found = found.union(broken_links(linked).select(F.lit("broken_links"), F.concat("page", F.lit(" -> "), "link")))
    found = found.union(missing_citations(pages).select(F.lit("missing_citations"), "page")).union(orphans(pages, linked).select(F.lit("orphans"), "page"))
    return found.distinct()


def lint_report(findings: DataFrame) -> DataFrame:
    """``kind, place, item``: the findings of each kind in order, a row each with its place from 1.

    Places come from a range sort: each range is numbered from where those before it end.
    """
    return placed(findings, ["kind"], ["item"])


#: The kinds of findings and their names in the summary line. Fixed values.
KINDS = {
    "broken_links": "broken_links", "missing_citations": "missing_citations", "unresolved_citations": "unresolved", "stale_citations": "stale",
    "placeholder_citations": "placeholders", "orphans": "orphans",
}


def lint_summary(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """``summary``: the counts of all kinds in one line."""
    counts = findings.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    head = F.concat(F.lit("pages="), pages.agg(F.count("*")).scalar())
    return counts.select(F.concat_ws(" ", head, *[F.concat(F.lit(f"{name}="), k) for k, name in KINDS.items()]).alias("summary"))
