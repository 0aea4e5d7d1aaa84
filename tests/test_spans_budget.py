"""Overlap joins, names in texts and budgets, against plain loops and at sizes that all pairs could not carry."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loam.functions import lineage
from loam.operators import incremental, mentions, pages, spans, summarize


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)

    def side(n):
        rows = [(rng.choice("ab"), a := rng.randrange(200), a + rng.choice([0, 0, 1, 2, 3, 7, 8, 31, 150]), i) for i in range(n)]
        return rows + [("a", 9, 3, n), (None, 1, 2, n + 1), ("a", None, 5, n + 2), ("b", 5, None, n + 3), ("b", 0, 1 << 30, n + 4), ("b", -9, -2, n + 5)]

    left, right = side(120), side(90)
    a = spark.createDataFrame(left, "k string, s int, e int, i int")
    b = spark.createDataFrame(right, "k string, t long, u long, j int")
    got = sorted((r.i, r.j) for r in spans.overlapping(a, b, "k", ("s", "e"), ("t", "u")).collect())
    want = sorted((i, j) for k, s, e, i in left for m, t, u, j in right if k and k == m and None not in (s, e, t, u) and s <= u and t <= e)
    assert got == want
    assert spans.overlapping(a.limit(0), b, "k", ("s", "e"), ("t", "u")).collect() == []


def test_a_file_with_very_many_symbols_and_citations(spark):
    """Both sides 100,000 spans in one file: all pairs would be 10 billion."""
    began = time.time()
    symbols = spark.range(100_000).select(F.lit("f.py").alias("path"), F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 8).cast("int").alias("end_line"))
    cited = spark.range(100_000).select(F.lit("f.py").alias("path"), F.concat(F.lit("p"), "id").alias("page"), (F.col("id") * 10 + 5).cast("int").alias("start"), (F.col("id") * 10 + 12).cast("int").alias("end"))
    assert incremental.citation_symbols(cited, symbols).count() == 199_999
    assert time.time() - began < 60


def test_overlaps_compute_both_sides_once_and_broadcast_nothing(spark):
    """One long span must not lay all short ones into each level below its own, nor may what is laid pass the driver."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    symbols = spark.range(1_000).selectExpr("'f.py' as path", "id", "cast(id * 2 as int) as start_line", "cast(id * 2 + 1 as int) as end_line")
    symbols = symbols.mapInPandas(counted, symbols.schema)
    cited = spark.createDataFrame([("f.py", 0, 2, 999_999), ("f.py", 1, 2, 6)], "path string, page int, start int, end int")
    got = spans.overlapping(cited, symbols, "path", ("start", "end"), ("start_line", "end_line"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 999 + 3 and made.value == 1_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spans.overlapping(cited, symbols, "path", ("start", "end"), ("start_line", "end_line"))._jdf.queryExecution().executedPlan()
        plan.execute().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 1_000 <= max(_rows_made(plan, "Generate")) <= 6_000  # a bin or two in each of two levels; in 20 levels they make over 20,000


def _rows_made(plan, name):
    """How many rows each operator of this name has put out."""
    own = [plan.metrics().get("numOutputRows").get().value()] if plan.nodeName() == name else []
    return own + [n for i in range(plan.children().size()) for n in _rows_made(plan.children().apply(i), name)]


@pytest.mark.parametrize("lot", [mentions.LOT, 12])
def test_names_in_texts(spark, lot):
    names = ["order", "or", "border line", "é", "a.b", "", None, "zzz", "日本", "order"]
    texts = [(1, "the border line of orders"), (2, "aXb a.b"), (3, "café 日本語"), (4, ""), (5, None), (5, "or"), (6, "nothing" * 10_000)]
    t, n = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame([(x,) for x in names], "n string")
    got = sorted((r.name, r.key) for r in mentions.mentions(t, "id", "body", n, "n", lot).collect())
    assert got == sorted((x, i) for x in {x for x in names if x} for i, body in texts if x in (body or ""))
    assert mentions.mentions(t, "id", "body", n.limit(0), "n").collect() == []


def test_capability_summaries_by_name_or_evidence(spark):
    groups = spark.createDataFrame([("Orders", ["x.py:L1-L2"]), ("gone", ["y.py:L3-L4", "z.py:L1-L1"]), ("a", ["q.py:L1-L1"])], "capability string, evidence array<string>")
    told = spark.createDataFrame([("x.py", None, "Handles ORDERS", ""), ("w.py", "reorders", None, None), ("v.py", "-", "b", "c")], "path string, business_relevance string, what_it_does string, responsibility string")
    got = {tuple(r) for r in pages.capability_summaries(groups, told).collect()}
    assert got == {("Orders", "x.py"), ("Orders", "w.py"), ("gone", "y.py"), ("gone", "z.py"), ("a", "x.py")}


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_and_admission(spark, parts):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(30))) for i in range(200)]
    rng.shuffle(rows)
    prompts = spark.createDataFrame(rows, "pos int, prompt string").repartition(parts)
    got = {r.pos: (r.cost, r.admitted) for r in summarize.admit(prompts, ["pos"], 1500, 5).collect()}
    total, want = 0, {}
    for pos, text in sorted(rows):
        cost = int((1 + len(text.split())) * 1.35) + 5
        total += cost
        want[pos] = (cost, total <= 1500)
    assert got == want and {a for _, a in got.values()} == {True, False}
    assert {r.admitted for r in summarize.admit(prompts, ["pos"], None).collect()} == {True}
    sums = lineage.running(prompts.select("pos").withColumn("v", F.col("pos") % 3), ["pos"], "v", "t").collect()
    assert {r.pos: r.t for r in sums} == {i: sum(k % 3 for k in range(i + 1)) for i in range(200)}


def test_a_budget_stops_calls(spark, tmp_path):
    """Models are asked only as far as the budget goes, stage by stage; the rest keep the fallback and are reported."""
    calls = f"{tmp_path}/calls"
    files = spark.createDataFrame([(f"c{i % 3}/f{i}.py", "python", 5, f"h{i}", f"text {i}", i) for i in range(12)], "path string, lang string, size long, hash string, text string, pos int")
    symbols = spark.createDataFrame([], "id string, kind string, name string, path string, start_line int, end_line int, signature string, docstring string, calls array<string>, imports array<string>, ord int")
    prompts = files.select("path", F.concat(F.lit("tell "), "path").alias("prompt"))

    @F.pandas_udf("string")
    def model(prompt):
        import os
        import uuid

        os.makedirs(calls, exist_ok=True)
        for p in prompt:
            open(f"{calls}/{uuid.uuid4().hex}", "w").write(p)
        return prompt.map(lambda p: '{"responsibility": "model"}')

    budget = summarize.Budget(limit=100, reserve=10)  # a call costs 3 words, 4 tokens, and 10: seven calls
    got = {r.path: r.responsibility for r in summarize.summarize_files(files, symbols, prompts, model, budget=budget).collect()}
    asked = {re.search(r"f(\d+)", open(p).read())[1] for p in tmp_path.glob("calls/*")}
    assert asked == {str(i) for i in range(7)} and budget.spent == 98
    assert {p for p, r in got.items() if r == "model"} == {f"c{i % 3}/f{i}.py" for i in range(7)} and budget.refused["files"].count() == 5
    some = spark.createDataFrame([("c0", "old")], "component string, responsibility string")
    kept = summarize._retold(some, "component", budget.send("components", some.select("component", F.lit("x").alias("prompt")), "component", ["component"]), model, ["responsibility"])
    assert [r.responsibility for r in kept.collect()] == ["old"] and budget.refused["components"].count() == 1 and len(list(tmp_path.glob("calls/*"))) == 7


def test_dry_run_counts_all_levels(spark):
    one = lambda *texts: spark.createDataFrame([(t,) for t in texts], "prompt string")
    rows = summarize.run_plan(one("a b c", "d"), one("e f"), one("g"), 20).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: -r.remaining)] == [("files", 2, 7, 13), ("components", 1, 4, 9), ("system", 1, 2, 7)]
