"""A whole build: model, cache, budget, strict gate, and everything it writes."""

import pytest
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import text as T
from loam.operators import build, parse, summarize
from loam.sources import files as sources

TEXTS = {
    "shop/api.py": 'from shop import db\n@app.get("/orders/list")\ndef orders():\n    return load()\n',
    "shop/db.py": "import redis\ndef load():\n    return 1\n",
    "tools/run.py": "def main():\n    pass\n",
}
ONLY = ["components/shop.md", "components/tools.md", "00-overview/executive-summary.md"]


@pytest.fixture(scope="module")
def code(spark):
    rows = [(p, "python", len(t), None, t, i) for i, (p, t) in enumerate(sorted(TEXTS.items()))]
    files = spark.createDataFrame(rows, schemas.FILES).withColumn("hash", T.content_hash("text"))
    return files, parse.parse_python(files)


def told(level):
    """A model that answers every prompt, with this confidence."""
    return lambda prompt: F.when(F.col(prompt).isNotNull(), F.lit('{"responsibility": "Told.", "confidence": "%s", "executive_summary": "All told."}' % level))


def summaries(built):
    return {r.path: r.responsibility for r in built.summaries.collect()}


def test_a_build_is_written_and_its_cache_spares_the_model(spark, code, tmp_path):
    root = f"file://{tmp_path}/site"
    first = build.generate(*code, told("high"), only_pages=ONLY, budget=summarize.Budget(100_000), strict=True)
    assert set(summaries(first).values()) == {"Told."} and not first.gated and first.budget.spent > 0
    assert {r.rel_path: r.summary for r in first.pages.collect()} == {"components/shop.md": "Told.", "components/tools.md": "Told.", "00-overview/executive-summary.md": "All told."}
    build.write_build(first, root, "repo", "2026-01-02 03:04:05")
    build.write_build(first, root, "repo", "2026-01-02 03:04:06")
    cache = sources.load_summaries(spark, f"{root}/summaries")
    assert cache.count() == len(TEXTS) and {r.detail for r in spark.read.parquet(f"{root}/log").collect()} == {"3 pages"}
    assert {r.rel_path for r in spark.read.parquet(f"{root}/pages").collect()} == {*ONLY, "AGENTS.md"}
    assert {r.page for r in sources.load_pagemap(spark, f"{root}/pagemap").collect()} <= set(ONLY)
    assert {(r.path, r.source_root) for r in spark.read.parquet(f"{root}/manifest").collect()} == {(p, "repo") for p in TEXTS}
    again = build.generate(*code, told("high"), cache, only_pages=ONLY[:1], budget=summarize.Budget(0))
    assert again.budget.spent == 0 and set(summaries(again).values()) == {"Told."}  # from the cache
    assert again.budget.refused["files"].isEmpty() and again.budget.refused["components"].count() == 2


def test_strict_builds_drop_what_is_not_sure(spark, code):
    strict = build.generate(*code, told("low"), only_pages=ONLY[:1], strict=True)
    assert strict.gated and "Told." not in {r.summary for r in strict.pages.collect()}
    assert {r.responsibility for r in strict.components.collect()} != {"Told."} and set(summaries(strict).values()) == {"Told."}  # kept for the cache
    loose = build.generate(*code, told("low"), only_pages=ONLY[:1])
    assert not loose.gated and {r.summary for r in loose.pages.collect()} == {"Told."}


def test_every_component_has_a_page(spark):
    """Fourteen components of one file each, two more than a page list was once cut to."""
    rows = [(f"part{i:02d}/a.py", "python", 20, str(i), f"def f{i}():\n    pass\n", i) for i in range(14)]
    files = spark.createDataFrame(rows, schemas.FILES)
    wanted = [f"components/part{i:02d}.md" for i in range(14)]
    built = build.generate(files, parse.parse_python(files), told("high"), only_pages=wanted)
    assert {r.rel_path: r.summary for r in built.pages.collect()} == dict.fromkeys(wanted, "Told.")


def test_code_files_are_dealt_over_cores_and_parsed_once(spark):
    """A table of one row group gives files to more than one task, and queries read what has been parsed, not the parser."""
    from loam.plans import registry, synth

    sf = "/root/testdata/sf0.01"  # 2,000 parts
    assert synth.code(spark, sf).rdd.getNumPartitions() > 1
    for name in ("component_links", "capability_files", "dry_run_levels"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "supplier.parquet" not in plan, name
