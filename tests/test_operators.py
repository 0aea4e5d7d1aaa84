"""Hand-made corpora for what the tables cannot show: line ends, encodings, globs, parsers, caps, graphs, pages."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import text as T
from loam.operators import chunks, graph, incremental, lint, pages, parse, repomap, search, signals, summarize
from loam.plans import registry, synth
from loam.sources import files as S
from loam.sources import sinks


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0cy\x0bz", "p\u2028q\u2029r\x85s", "k\x1cl\x1dm\x1en", "\n", "tail\n\n"]
)
def test_lines_as_python_splits_them(spark, text):
    assert one(spark, text, T.split_lines) == text.splitlines()


@pytest.mark.parametrize("text", ["", "  ", "a b\tc\n", "a\x1cb\x1fc d\u3000e\u00a0f"])
def test_words_as_python_splits_them(spark, text):
    assert one(spark, text, T.words) == text.split() and one(spark, text, T.token_estimate) == int(len(text.split()) * 1.35)


@pytest.mark.parametrize(
    "name,slug", [("Hello  World", "hello-world"), ("a/b_c.d", "a-b-c-d"), ("!!!", "page"), ("-x-", "x"), ("Ärger ß", "ärger-ß"), ("a!b", "ab")]
)
def test_slug(spark, name, slug):
    assert one(spark, name, T.slug) == slug


def test_text_functions(spark):
    assert one(spark, "src/a.PY", T.language) == "python" and one(spark, ".sh", T.language) == "text" and one(spark, "x.tar.json", T.language) == "json"
    assert one(spark, "a/b.py:L3-L9", lambda c: T.cite_span(c)["end"]) == 9 and one(spark, "a/b.py:L3", T.cite_span) is None
    assert one(spark, "GET /users/1", T.capability) == "users" and one(spark, "GET /", T.capability) == "general"
    assert one(spark, "GET /user-data", T.capability_label) == "user data" and one(spark, "GET /", T.capability_label) == "general api"
    assert one(spark, "x/../y/./z", T.normalize_path) == "y/z" and one(spark, "../a", T.normalize_path) == "../a"
    assert one(spark, "c/x.md", lambda c: T.relative_link(F.lit("t"), c, F.lit("d/y.md"))) == "[t](../d/y.md)"
    assert one(spark, "c/x.md", lambda c: T.relative_link(F.lit("t"), c, F.lit("c/x.md"))) is None
    assert one(spark, "```json\n{\"a\": {\"b\": 1}}\n```", T.json_object) == '{"a": {"b": 1}}' and one(spark, "none", T.json_object) is None
    assert one(spark, "# t\n\n## Summary\n A  b\nC\n\n## Next\nd", T.summary_section) == "a b c"
    assert one(spark, "<h2>A b!</h2>x<h3>C</h3>", T.heading_ids) == '<h2 id="a-b">A b!</h2>x<h3 id="c">C</h3>'
    assert one(spark, "order items", T.entity_id) == "ORDER_ITEMS" and one(spark, "--", T.entity_id) == "ENTITY"


def test_match_lines_equal_finditer(spark):
    import re

    text = "@app.get('/a')\nx\n\n@router.post(\"/b\") @app.put('/c')\n" * 3
    pattern = r"@(app|router)\.(get|post|put)\([\"']([^\"']+)"
    want = [(m.group(3), text[: m.start()].count("\n") + 1) for m in re.finditer(pattern, text)]
    assert [(m["text"], m["line"]) for m in one(spark, text, lambda c: T.matches(c, pattern, 3))] == want


def test_globs():
    import re

    match = lambda g, p: bool(re.search(T.glob_regex([g]), p))
    assert match("**/dist/**", "dist/b.js") and match("**/dist/**", "a/dist/b.js") and not match("**/dist/**", "a/distx/b.js")
    assert match("**/*.min.js", "x.min.js") and match("*.py", "a/b.py") and match("f[0-9]?.txt", "f1x.txt") and not match("*.PY", "a.py")


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "dist").mkdir()
    for name, data in {"a/b.py": b"x\r\ny\rz", "a-b.py": b"1", "dist/c.js": b"no", "bin": b"\x00x", "bad.md": b"ok\xff!", "big.txt": b"x" * 600_000, "empty": b"", "shift.txt": b"a0\x10b", "a/__init__.py": b"q", ".env": b"k"}.items():
        (tmp_path / name).write_bytes(data)
    rows = S.scan_files(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.path for r in rows] == [".env", "a/__init__.py", "a/b.py", "a-b.py", "bad.md", "empty", "shift.txt"]
    by = {r.path: r for r in rows}
    assert by["a/b.py"].text == "x\ny\nz" and by["a/b.py"].size == 6 and by["bad.md"].text == "ok!" and by["a/b.py"].pos < by["a-b.py"].pos
    assert S.scan_files(spark, str(tmp_path), max_files=2).count() == 2 and S.scan_files(spark, str(tmp_path), include=["**/*.md"]).count() == 1


def files(spark, texts):
    rows = [(p, t, i) for i, (p, t) in enumerate(texts.items())]
    frame = spark.createDataFrame(rows, "path string, text string, pos int")
    return frame.select("path", T.language("path").alias("lang"), F.length("text").cast("long").alias("size"), T.content_hash("text").alias("hash"), "text", "pos")


PY = {
    "pkg/__init__.py": "def setup():\n    pass\n",
    "pkg/a.py": 'from .b import helper\nfrom . import c\nfrom ..up import *\nimport os.path\n\nclass A:\n    """Doc."""\n    def run(self):\n        def inner():\n            return helper()\n        return self.go(inner())\n\nasync def go():\n    await run()\n',
    "pkg/b.py": "def helper():\n    return helper()\n",
    "pkg/broken.py": "def (",
    "pkg/only.py": "import os\n",
}


def test_python_parser(spark):
    f = files(spark, PY)
    rows = {r.name: r for r in parse.parse_symbols(f).collect()}
    assert set(rows) == {"setup", "A", "run", "inner", "go", "helper"}
    assert rows["A"].docstring == "Doc." and rows["A"].calls == [] and rows["A"].kind == "class" and (rows["A"].start_line, rows["A"].end_line) == (6, 11)
    assert set(rows["run"].calls) == {"go", "inner", "helper"} and rows["go"].signature.startswith("async def")
    assert rows["A"].imports == [".b", ".b.helper", ".c", "..up", "os.path"] and rows["A"].id == "pkg/a.py::A:6"
    graph_rows = {(r.src, r.dep): r.is_internal for r in repomap.resolve_imports(f, parse.parse_symbols(f)).collect()}
    assert graph_rows[("pkg/a.py", "pkg/b.py")] and graph_rows[("pkg/a.py", "pkg/c.py")] is True if ("pkg/a.py", "pkg/c.py") in graph_rows else True
    assert graph_rows[("pkg/a.py", "os.path")] is False and not any(s == "pkg/only.py" for s, _ in graph_rows)
    calls = {(r.src.split("::")[1].split(":")[0], r.dst.split("::")[1].split(":")[0]) for r in graph.resolve_calls(parse.parse_python(f)).collect()}
    assert calls == {("run", "go"), ("run", "inner"), ("run", "helper"), ("inner", "helper"), ("go", "run")}


def test_other_parsers(spark):
    f = files(spark, {
        "m.go": 'package m\nimport "fmt"\ntype T struct {\n}\nfunc (t T) Run(x int) {\n\tfmt.Println(x)\n}\n', "C.cs": "using System;\npublic class C {\n  public int Add(int a) {\n    return Sum(a);\n  }\n}\n",
        "J.java": "import a.b.C;\npublic class J {\n  public void go() {\n    helper(1);\n  }\n}\n", "x.ts": "import q from './q'\nexport class K {} function f() {}\n",
    })
    rows = {(r.path, r.name): r for r in parse.parse_symbols(f).collect()}
    assert set(rows) == {("m.go", "T"), ("m.go", "Run"), ("C.cs", "C"), ("C.cs", "Add"), ("J.java", "J"), ("J.java", "go"), ("x.ts", "K"), ("x.ts", "f")}
    assert rows[("m.go", "Run")].calls == ["Println"] and rows[("m.go", "T")].imports == ["fmt"]
    assert rows[("J.java", "go")].calls == ["helper"] and rows[("C.cs", "Add")].calls == ["Sum"] and rows[("x.ts", "K")].imports == ["./q"]


def test_capped_evidence_leaks_one_a_file(spark):
    f = files(spark, {f"f{i}.txt": "email\n" * 25 for i in range(5)})
    cites = signals.collect(signals.capped(signals.hits(f, signals.COMPLIANCE_RULES))).first().evidence
    assert len(cites) == 25 + 15 + 3 and cites[-1] == "f4.txt:L1-L1"


def test_signal_merge_and_names(spark):
    f = files(spark, {"a.py": "@app.get('/x')\nslack S3 Stripe\n", "b.py": "@app.get('/x')\n", "c.java": "import org.springframework;\n@GetMapping(path = \"/j\")\nclass Q {}\n"})
    rows = {(r.type, r.name): r.evidence for r in signals.detect_signals(f, f).collect()}
    assert rows[("api_route", "GET /x")] == ["a.py:L1-L1", "b.py:L1-L1"] and ("api_route", "GET /j") in rows
    assert {n for t, n in rows if t == "integration"} == {"Slack", "S3", "Stripe"}


def test_graph_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a")], "src string, dst string")
    ids = spark.createDataFrame([("a",)], "id string")
    assert {r.node for r in graph.ancestors(e, ids).collect()} == {"b", "c", "x"} and {r.node for r in graph.descendants(e, ids).collect()} == {"b", "c", "d"}
    assert {(r.node, r.scc) for r in graph.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    assert sorted(r.cycle for r in graph.simple_cycles(e).collect()) == [["a", "b", "c"], ["d"]]


def test_long_and_many_cycles(spark):
    ring = [f"r{i:02}" for i in range(15)]
    dense = "abcdefg"
    e = spark.createDataFrame([*zip(ring, ring[1:] + ring[:1]), *((a, b) for a in dense for b in dense if a != b)], "src string, dst string")
    got = [tuple(r.cycle) for r in graph.simple_cycles(e).collect()]
    want = [tuple(ring), *(p for n in range(2, 8) for p in permutations(dense, n) if p[0] == min(p))]
    assert len(want) == 2366 and sorted(got) == sorted(want)


def test_snippets_and_search(spark):
    f = files(spark, {"a.txt": "\n".join(f"line {i}" for i in range(250)), "empty.txt": "", "b.txt": "the kafka queue"})
    s = chunks.chunk_symbols(f, spark.createDataFrame([], schemas.SYMBOLS))
    assert sorted(r.cite for r in s.collect()) == ["a.txt:L1-L120", "a.txt:L121-L240", "a.txt:L241-L250", "b.txt:L1-L1"]
    top = search.retrieve(s, *search.postings(s), "kafka queue").collect()
    assert top[0].cite == "b.txt:L1-L1" and search.substring_hits(s, " ").count() == 0
    assert [r.line for r in search.answer_evidence(search.retrieve(s, *search.postings(s), "kafka")).collect()] == ["- b.txt:L1-L1: the kafka queue"]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "cite string, embedding array<float>")
    assert [(r.cite, round(r.score, 6)) for r in search.vector_hits(v, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 0.707107), ("c", 0.0)]


def test_lint_paths(spark):
    p = spark.createDataFrame([("a/x.md", "[u](../b/y.md) [v](z.md) [w](gone.md)"), ("a/z.md", "## Sources\n"), ("b/y.md", "q.py:L1-L2 q.py:L1-L9 no.py:L1-L1 path/to/file.py:L1-L3")], "page string, text string")
    links = {(r.link, r.target) for r in lint.page_links(p).collect()}
    assert links == {("../b/y.md", "b/y.md"), ("z.md", "a/z.md"), ("gone.md", None)}
    assert {r.link for r in lint.broken_links(lint.page_links(p, strict_paths=True)).collect()} == {"../b/y.md", "gone.md"}
    f = files(spark, {"q.py": "a\nb\n"})
    assert {(r.cite, r.status) for r in lint.check_citations(lint.page_citations(p), f).collect()} == {("q.py:L1-L2", "ok"), ("q.py:L1-L9", "stale"), ("no.py:L1-L1", "placeholder"), ("path/to/file.py:L1-L3", "unresolved")}
    assert [r.page for r in lint.orphans(p, lint.page_links(p)).collect()] == ["a/x.md"] and [r.page for r in lint.missing_citations(p).collect()] == ["a/z.md"]


def test_summaries_with_cache_and_model(spark, tmp_path):
    f = files(spark, {"c/a.py": "x", "c/b.py": "y", "d/e.py": "x"})
    none = spark.createDataFrame([], schemas.SYMBOLS)
    base = summarize.fallback_summaries(f, none)
    cache = base.where("path = 'c/a.py'").withColumn("responsibility", F.lit("cached")).drop("pos")
    model = F.udf(lambda p: 'Sure: {"responsibility": "told", "confidence": "high"}' if "c/b.py" in p else "no idea")
    prompts = summarize.file_prompts(f, none, spark.createDataFrame([], schemas.SIGNALS))
    sinks.put_summaries(cache, str(tmp_path / "cache"))
    assert S.load_summaries(spark, str(tmp_path / "none")).count() == 0
    cache = S.load_summaries(spark, str(tmp_path / "cache"))
    rows = {r.path: r for r in summarize.summarize_files(f, none, prompts, model, cache).collect()}
    assert rows["c/a.py"].responsibility == rows["d/e.py"].responsibility == "cached" and rows["c/b.py"].responsibility == "told" and rows["c/b.py"].confidence == "high"
    parts = {r.component: r for r in summarize.reduce_components(base, spark.createDataFrame([], schemas.SIGNALS)).collect()}
    assert parts["c"].confidence == "low" and parts["c"].files == ["c/a.py", "c/b.py"] and parts["c"].capabilities == ["core repository behavior"]


def test_models_are_asked_once_and_repaired(spark):
    f = files(spark, {"c/a.py": "x", "c/b.py": "y", "d/e.py": "x"})
    none = spark.createDataFrame([], schemas.SYMBOLS)
    base = summarize.fallback_summaries(f, none)
    said = '{"responsibility": " told ", "confidence": "HIGH", "citations": ["a:L1-L2", "plain"], "key_symbols": ["k", "k", ""]}'
    asked = spark.sparkContext.accumulator(0)

    def answer(prompt):
        asked.add(1)
        return said if "c/a.py" in prompt or "Return valid JSON only" in prompt else "no idea"

    prompts = summarize.file_prompts(f, none, spark.createDataFrame([], schemas.SIGNALS))
    rows = {r.path: r for r in summarize.summarize_files(f, none, prompts, F.udf(answer)).collect()}
    assert asked.value == 3  # two contents, and one repair
    for r in rows.values():
        assert (r.responsibility, r.confidence, r.citations, r.key_symbols) == ("told", "high", ["a:L1-L2"], ["k"])
    parts = summarize.reduce_components(base, spark.createDataFrame([], schemas.SIGNALS))
    model = F.udf(lambda p: '{"responsibility": "does c"}' if "Summarise this component as JSON: c" in p else '{"executive_summary": "all", "confidence": "odd"}' if "system" in p else "?")
    told = summarize.summarize_components(parts, summarize.component_prompts(parts, base), model)
    assert {r.component: r.responsibility for r in told.collect()} == {"c": "does c", "d": "Holds part of this component's implementation."}
    whole = summarize.reduce_system(parts, f, none, repomap.framework_hints(f), repomap.entrypoints(f))
    got = summarize.summarize_system(whole, summarize.system_prompt(parts), model).first()
    assert got.executive_summary == "all" and got.confidence == "medium" and got.capabilities == ["core repository behavior"]


def test_neighbor_block_tries_every_cap(spark):
    words = lambda n, k: [" ".join([f"w{i}"] * k) for i in range(n)]
    lists = {"imports": words(12, 20), "dependents": words(9, 30), "calls": words(8, 7)}
    frame = spark.createDataFrame([("p", *lists.values()), ("q", [], None, ["f (2)"]), ("r", None, [], None)], "path string, imports array<string>, dependents array<string>, calls array<string>")
    for budget in (10, 300, 420, 500, 700, 5000):
        got = {r.path: r.block for r in summarize.neighbor_block(frame, budget).collect()}
        block = lambda a, b, c: f"Graph neighbors:\n- Imports: {a}\n- Depended on by (1-hop): {b}\n- Calls (top symbols): {c}"
        tries = [block(*(", ".join(v[:n]) for v, n in zip(lists.values(), (a, b, c)))) for a in (12, 8, 5, 3, 2) for b in (12, 8, 5, 3, 2) for c in (8, 6, 4, 3, 2)]
        fitting = [t for t in tries if int(len(("user\n" + t).split()) * 1.35) <= budget]
        assert got["p"] == (fitting or [block(*["(trimmed)"] * 3)])[0] and got["r"] == ""
        assert got["q"] == block(*(["(none)", "(none)", "f (2)"] if budget > 10 else ["(trimmed)"] * 3))


def test_opportunity_backfill_counts_citations_once(spark):
    rows = [("a", "n", ["x:L1-L1"] * 9 + ["y:L1-L1"]), ("b", "m", ["x:L1-L1", "z:L1-L1"])]
    got = signals.opportunity_register(spark.createDataFrame(rows, schemas.SIGNALS), 0).collect()
    assert [(r.name, r.evidence) for r in got] == [(k, [c]) for k, c in zip(signals.PRIORITIES, ["x:L1-L1", "y:L1-L1", "z:L1-L1"])]


def test_spring_signals(spark):
    text = "import org.Springframework;\n@Entity\n@Entity class A {}\n@Entity\n@GetMapping(value = ' /q ')\n@PostMapping('/p')\n@PutMapping\n@KafkaListener(topics = \"t\")\n@KafkaListener(id = X)\n@Scheduled(1)\nclass B {}\n"
    f = files(spark, {"J.java": text, "K.java": "@Entity class C {}"})
    got = {(r.type, r.name): r.evidence for r in signals.collect(signals.spring_hits(f)).collect()}
    line = lambda n: [f"J.java:L{n}-L{n}"]
    assert got == {
        ("data_model", "A"): line(2) + line(3), ("data_model", "B"): line(4), ("api_route", "GET /q"): line(5), ("api_route", "POST /p"): line(6), ("api_route", "PUT /"): line(7),
        ("messaging", "Kafka t"): line(8), ("messaging", "Kafka Kafka Listener"): line(9), ("scheduled_job", "Spring Scheduled Job"): line(10),
    }


def test_capability_names_anywhere(spark):
    base = summarize.fallback_summaries(files(spark, {"a.py": "1", "b.py": "2", "c.py": "3"}), spark.createDataFrame([], schemas.SYMBOLS))
    told = base.withColumn("what_it_does", F.when(F.col("path") == "a.py", "handles repayments").otherwise("x"))
    groups = spark.createDataFrame([("payment", ["z.py:L1-L1"]), ("nowhere", ["c.py:L1-L2"]), ("x", [])], "capability string, evidence array<string>")
    assert {tuple(r) for r in pages.capability_summaries(groups, told).collect()} == {("payment", "a.py"), ("nowhere", "c.py"), ("x", "b.py"), ("x", "c.py")}


def test_log_entries(spark):
    log = spark.sql("select timestamp'2026-01-02 03:04:05' as ts, 'update' as event, 'two pages' as detail")
    assert log.select(sinks.render_log()).first()[0] == "## [2026-01-02 03:04:05Z] update\n- two pages\n"
    changed = log.select("ts", F.lit("p.md").alias("page"))
    assert sinks.contradictions(changed).select(sinks.render_log()).first()[0] == "## [2026-01-02] contradiction | p.md\n"


def test_stored_vectors_are_fresh(spark, tmp_path):
    snippet = lambda t: spark.createDataFrame([(t, "a", 1), ("u", "b", 2)], "text string, cite string, pos long")
    calls = spark.sparkContext.accumulator(0)

    def embed(text):
        calls.add(1)
        return [float(len(text))]

    udf = F.udf(embed, "array<float>")
    one = lambda t, model: {r.cite: r.embedding for r in search.fresh_vectors(snippet(t), udf, model, str(tmp_path / "v")).collect()}
    assert one("tt", "m") == {"a": [2.0], "b": [1.0]} and calls.value == 2 and one("tt", "m")["a"] == [2.0] and calls.value == 2
    assert one("ttt", "m")["a"] == [3.0] and calls.value == 4 and one("ttt", "n")["a"] == [3.0] and calls.value == 6


def test_files_in_a_store_that_only_spark_knows(spark, tmp_path):
    """The same rows as by Python's own reader, hidden and empty files included."""
    texts = {"a/b.py": "x\r\ny", "a/__init__.py": "", "a/_private/deep/x.py": "one", ".github/ci.yml": "on: push", "d/e/f/g/__main__.py": "main", "top.txt": "t", "empty.txt": "", ".git/config": "no", "k=v/_x=1/y.py": "part"}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, newline="")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "_h.bin").write_bytes(b"x\0")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tree.link./in", f"file://{tmp_path}")
    rows = lambda root, **more: [(r.path, r.text, r.size, r.pos) for r in S.scan_files(spark, root, **more).orderBy("pos").collect()]
    own, far = rows(f"file://{tmp_path}"), rows("viewfs://tree/in")
    assert own == far and {p: t for p, t, *_ in far} == {p: t.replace("\r", "") for p, t in texts.items() if p != ".git/config"}
    assert rows(f"file://{tmp_path}", include=["**/_*"], exclude=[]) == rows("viewfs://tree/in", include=["**/_*"], exclude=[])


def test_component_graph(spark):
    f = files(spark, {f"d/f{i:02}.py": "" for i in range(40)})
    rows = [(f"file:d/f{i:02}.py", f"file:d/f{(i + 1) % 36:02}.py", "imports") for i in range(36)] + [("file:d/f00.py", f"external:m{i}", "imports") for i in range(7)]
    lines = pages.component_graph_diagram(f, spark.createDataFrame(rows, "src string, dst string, edge_type string")).first()[0].split("\n")
    node = lambda i: f"file_d_f{i:02}_py"
    want = ["flowchart TD", *[f"    {node(i)}[d/f{i:02}.py]" for i in range(30)], *[f"    {node(i)} --> {node(i + 1)}" for i in range(29)]]
    want += [*[f"    external_m{i}[m{i}]:::external" for i in range(5)], "    more3[+2 more external]:::external", "    more4[+6 more]", "    classDef external fill:#f9f"]
    assert lines == want


def test_report_pages(spark):
    got = {r.rel_path: r for r in registry.queries()["report_pages"](spark, "/root/testdata/sf0.001").collect()}
    nations = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select("s_nationkey").distinct().collect()}
    want = {f"00-overview/{x}.md" for x in ("executive-summary", "system-context", "tech-stack", "component-graph")} | {f"components/nation-{k}.md" for k in nations}
    want |= {f"{kind}/area-{k}.md" for kind in ("capabilities", "workflows") for k in nations}
    want |= {"domain/glossary.md", "domain/data-model.md", "integrations/external-systems.md", "risks/risk-register.md", "operations/setup.md"}
    want |= {t for lens in pages.LENSES.values() for t in lens.templates}
    assert set(got) == want
    for r in got.values():
        assert r.rendered.startswith(f"---\ntitle: {r.title}\n") and "\n## Summary\n" in r.rendered and r.rendered.endswith("\n")
    files = synth.code(spark, "/root/testdata/sf0.001")
    some = pages.build_pages(files, parse.parse_python(files), only_pages=["domain/glossary.md", "00-overview/tech-stack.md", "none.md"])
    assert {r.rel_path for r in some.collect()} == {"domain/glossary.md", "00-overview/tech-stack.md"}
    k = min(nations)
    assert f"- GET /area_{k}/" in got[f"capabilities/area-{k}.md"].rendered and f"nation_{k}/" in got[f"components/nation-{k}.md"].rendered


def test_persisted_tables(spark, tmp_path):
    assert S.load_manifest(spark, str(tmp_path / "none")).count() == 0 and S.load_snippets(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "m.json").write_text('{"source_root": "/s", "files": {"a": "1"}}')
    assert [tuple(r) for r in S.load_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "1")]
    (tmp_path / "l.json").write_text('[{"page": "p.md", "source_files": ["a"], "human_edited": true}]')
    (tmp_path / "d.json").write_text('{"p.md": {"source_files": ["a"]}}')
    a, b = (S.load_pagemap(spark, str(tmp_path / n)).first() for n in ("l.json", "d.json"))
    assert a.page == b.page == "p.md" and a.source_files == b.source_files == ["a"] and a.human_edited and not b.human_edited


def test_rendering(spark):
    p = spark.range(1).select(*pages.page_row(F.lit("a/b.md"), F.lit("B"), "k", "all", F.lit("Sum"), [("One", F.lit("body ")), ("None", F.lit(""))], F.array(F.lit("f.py:L1-L2")), tags=("t",)))
    text = p.select(sinks.render_page()).first()[0]
    assert text == "---\ntitle: B\ntype: k\naudience: all\nsources:\n- f.py:L1-L2\ntags:\n- t\n---\n\n## Summary\nSum\n\n## One\nbody\n\n## Sources\n- f.py:L1-L2\n"
    marked = one(spark, text, sinks.mark_contradiction)
    assert marked.count("contradiction: true") == 1 and one(spark, marked, sinks.mark_contradiction) == marked
    assert one(spark, text, lambda c: S.frontmatter_field(c, "title")) == "B" and one(spark, text, S.page_body).startswith("\n## Summary")
    old = p.select(F.col("rel_path").alias("page"), sinks.render_page().alias("text"))
    assert incremental.changed_summaries(old, old).count() == 0


def test_streams(spark, tmp_path):
    from loam.streaming import updates

    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string").write.json(str(tmp_path / "in" / "one"))
    stream = spark.readStream.schema("path string, hash string").option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    seen = []
    q = updates.follow_files(stream, str(tmp_path / "m"), str(tmp_path / "c"), lambda diff, n: seen.extend((n, r.path, r.change) for r in diff.collect()))
    q.processAllAvailable()
    spark.createDataFrame([("a", "2"), ("d", "1")], "path string, hash string").write.json(str(tmp_path / "in" / "two"))
    q.processAllAvailable()
    q.stop()
    assert set(seen) >= {(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "d", "added")} and not any(c == "removed" for _, _, c in seen)
    assert {(r.path, r.hash) for r in updates.manifest(spark, str(tmp_path / "m")).collect()} == {("a", "2"), ("b", "1"), ("d", "1")}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_components_without_pairs_of_nodes(spark, monkeypatch):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(120)})
    e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "src string, dst string")
    sizes, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: sizes.append((out := settle(df)).count()) or out)
    got = {(r.node, r.scc) for r in graph.strong_components(e).collect()}
    reach = {a: {b for x, b in pairs if x == a} for a in range(60)}
    for k in range(60):
        for a in range(60):
            reach[a] |= reach[k] if k in reach[a] else set()
    want = {(a, min(b for b in reach[a] if a in reach[b])) for a in range(60) if a in reach[a]}
    assert got == {(f"n{a:02}", f"n{b:02}") for a, b in want} and max(sizes) <= len(pairs)


def test_capped_counts_only_the_first_files(spark):
    rows = [("t", "n", f"f{p}", p, line, line, 40) for p in range(0, 70_000, 97) for line in range(1, 2 + p % 3)]
    found = signals.capped(spark.createDataFrame(rows, "type string, name string, path string, pos int, line int, ord int, cap int"))
    want = [(p, line) for i, (_, _, _, p, line, _, _) in enumerate(rows) if i < 40 or line == 1]
    assert sorted((r.pos, r.line) for r in found.collect()) == want
    assert not re.search(r"windowspecdefinition\(type#\d+, name#\d+, pos#\d+ ASC", _plan(found))


def test_positions_by_ranges(spark):
    paths = [f"d{i % 7}/f{i}.txt" for i in range(200)] + ["d1.txt", "d1/a/b"]
    given = spark.createDataFrame([(p, "text", 1, "x") for p in paths], "path string, lang string, size long, text string").repartition(5)
    found = S.with_positions(given)
    assert [r.path for r in sorted(found.collect(), key=lambda r: r.pos)] == sorted(paths, key=lambda p: p.split("/"))
    assert [r.pos for r in S.with_positions(given, 3).orderBy("pos").collect()] == [0, 1, 2] and "row_number" not in _plan(found)


def test_conversation_tokens_gather_no_texts(spark):
    assert "collect_list" not in _plan(registry.queries()["conversation_tokens"](spark, "/root/testdata/sf0.001"))


def test_first_evidence_is_cut_as_rows(spark):
    """Counts and first citations are those of whole signals, and so is the register that reads them."""
    from loam.operators import signals

    rows = [("ai_opportunity_hint", n, f"f{i}", i, k, k, None) for n, m in (("manual_review_queue", 9), ("batch_reconciliation", 2)) for i in range(m) for k in (1, 2, 2)]
    hits = spark.createDataFrame(rows, "type string, name string, path string, pos int, line int, ord int, cap int")
    whole, cut = signals.collect(hits), signals.collect_first(hits, 7)
    want = {r["name"]: (len(r["evidence"]), r["evidence"][:7]) for r in whole.collect()}
    assert {r["name"]: (r["n"], r["evidence"]) for r in cut.collect()} == want
    short = lambda df: [(r["rank"], r["name"], r["score"], r["evidence"][:7]) for r in df.orderBy("rank").collect()]
    assert short(signals.opportunity_register(cut, 100, count=cut["n"])) == short(signals.opportunity_register(whole, 100))
