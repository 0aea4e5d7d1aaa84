"""Sinks: rendered pages, snapshots of tables, and the append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import text as T


def _yaml_list(key: str, items: Column) -> Column:
    filled = F.concat(F.lit(f"{key}:\n- "), F.array_join(items, "\n- "))
    return F.when(F.size(items) > 0, filled).otherwise(F.lit(f"{key}: []"))


def render_page() -> Column:
    """The Markdown of a row of pages: frontmatter, summary, sections, related pages and sources."""
    head = [F.concat(F.lit(f"{k}: "), F.col(k)) for k in ("title", "type", "audience")]
    head += [_yaml_list("sources", F.col("sources")), _yaml_list("tags", F.col("tags"))]
    head += [F.concat(F.lit("confidence: "), F.col("confidence"))]
    body = [F.lit("---"), *head, F.lit("---"), F.lit(""), F.lit("## Summary"), F.trim("summary")]
    parts = F.transform("sections", lambda s: F.concat(F.lit("\n## "), s["heading"], F.lit("\n"), F.trim(s["body"])))
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n- "), F.array_join(items, "\n- ")))
    text = F.concat_ws("\n", *body, F.nullif(F.array_join(parts, "\n"), F.lit("")), listed("Related", F.col("related")), listed("Sources", F.col("sources")))
    return F.concat(F.rtrim(text), F.lit("\n"))


def write_pages(pages: DataFrame, root: str) -> None:
    """All rendered pages as a table by folder; consumers read one page by ``rel_path``."""
    rows = pages.select(T.folder("rel_path").alias("folder"), "rel_path", render_page().alias("rendered"))
    rows.write.mode("overwrite").partitionBy("folder").parquet(root)


def write_index(snippets: DataFrame, postings: DataFrame, lengths: DataFrame, root: str) -> None:
    """The search tables, all replaced together so that no stale document stays; postings are clustered by term."""
    snippets.write.mode("overwrite").parquet(f"{root}/snippets")
    postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    lengths.write.mode("overwrite").parquet(f"{root}/lengths")


def write_vectors(vectors: DataFrame, root: str, signature: DataFrame) -> None:
    """Vectors and, once they are whole, the signature (one row) of the snippets and the model they stand for."""
    vectors.write.mode("overwrite").parquet(f"{root}/vectors")
    signature.write.mode("overwrite").parquet(f"{root}/signature")


def write_pagemap(pagemap: DataFrame, root: str) -> None:
    pagemap.orderBy("page").write.mode("overwrite").json(root)


def write_manifest(files: DataFrame, root: str, source_root: str) -> None:
    files.select("path", "hash", F.lit(source_root).alias("source_root")).write.mode("overwrite").parquet(root)


def put_summaries(summaries: DataFrame, root: str) -> None:
    """Append to the summary cache; readers take one row a content hash."""
    summaries.write.mode("append").parquet(root)


def page_index(pages: DataFrame) -> DataFrame:
    """``folder, entries``: the lines of the index page by first folder, in page order; roots and proposals left out."""
    kept = pages.where(~F.col("rel_path").isin("index.md", "log.md") & ~F.endswith("rel_path", F.lit(".proposed.md")))
    line = F.concat(F.lit("- ["), T.page_title("rel_path"), F.lit("]("), F.col("rel_path"), F.lit(")"))
    rows = kept.select(T.folder("rel_path").alias("folder"), "rel_path", line.alias("line"))
    entries = F.array_sort(F.collect_list(F.struct("rel_path", "line")))
    return rows.groupBy("folder").agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("entries"))


def append_log(events: DataFrame, root: str) -> None:
    """Events (``ts, event, detail``), contradictions among them, go to the end of the log."""
    events.select("ts", "event", "detail").write.mode("append").parquet(root)


def contradictions(changed: DataFrame) -> DataFrame:
    """Log rows for pages whose summaries changed (``page, ts``)."""
    return changed.select("ts", F.lit("contradiction").alias("event"), F.col("page").alias("detail"))


def render_log() -> Column:
    """An event's entry: a heading with its time and its detail as a list item; of a contradiction a heading alone."""
    plain = F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Z] "), F.col("event"), F.lit("\n- "), F.col("detail"), F.lit("\n"))
    short = F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] contradiction | "), F.col("detail"), F.lit("\n"))
    return F.when(F.col("event") == "contradiction", short).otherwise(plain)


def answer_page(question: Column | str, answer: Column | str) -> Column:
    """An answer filed back as a workflow page: a row like those of pages."""
    path = F.concat(F.lit("workflows/qa-"), F.left(T.slug(question), F.lit(48)), F.lit(".md"))
    none = F.array().cast("array<string>")
    sections = F.array(F.struct(F.lit("Answer").alias("heading"), T.c(answer).alias("body")))
    return F.struct(
        path.alias("rel_path"), T.c(question).alias("title"), F.lit("workflow").alias("type"), F.lit("all").alias("audience"), T.preview(answer).alias("summary"),
        sections.alias("sections"), F.array_distinct(T.citations(answer)).alias("sources"), none.alias("related"), F.array(F.lit("qa")).alias("tags"),
        F.lit(None).cast("string").alias("confidence"),
    )


def mark_contradiction(text: Column | str) -> Column:
    """The page with ``contradiction: true`` at the end of its frontmatter, once; other pages unchanged."""
    marked = F.regexp_replace(T.c(text), r"(?s)\A(---\n.*?)\n---\n", "$1\ncontradiction: true\n---\n")
    return F.when(F.rlike(T.c(text), F.lit(r"(?s)\A---\n.*?contradiction: true.*?\n---\n")), T.c(text)).otherwise(marked)


def agents_page(spark) -> DataFrame:
    """The constant page that tells agents how to read the pages."""
    body = "Read index.md first. Every claim cites path:Lx-Ly. Pages marked human-edited are not regenerated."
    row = ("AGENTS.md", "Agents", "guide", "agents", body, [], [], ["index.md"], ["agents"], None)
    return spark.createDataFrame([row], schemas.PAGES)
