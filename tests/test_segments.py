"""The index of segments: searches equal a plain BM25 over the live snippets, whatever changes and merges came before."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loam import schemas
from loam.operators import search, segments

WORDS = ["queue", "ledger", "Token", "audit", "kafka", "retry", "cache", "shard", "the", "é1", "a.b", "x_y"]


def rows(rng, ids, extra=""):
    out = []
    for i in ids:
        text = " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(1, 60))) + extra
        out.append((text, f"d/f{i}.py:L1-L9", 0.0, f"d/f{i % 17}.py", "python", f"run_{i % 5}", "function", i))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, schemas.SNIPPETS)


def split(text):
    found = re.findall(r"[^\W]+(?:\.[^\W]+)*", text.lower())
    return [w for w in found if len(w) > 1 and w not in search.STOP_WORDS]


def plain(data, queries, k, every=False):
    """BM25 summed over fields, with plain loops."""
    live = {r[1]: r for r in sorted(data, key=lambda r: r[7])}
    fields = {c: {"body": split(r[0]), "path": [r[3].lower()], "symbol": split(r[5])} for c, r in live.items()}
    out = set()
    mean = {f: sum(len(x[f]) for x in fields.values()) / len(fields) for f in ("body", "path", "symbol")}
    df = defaultdict(int)
    for x in fields.values():
        for f, words in x.items():
            for w in set(words):
                df[f, w] += 1
    for q, text in queries:
        asked, scores = set(split(text)), []
        for cite, x in fields.items():
            score, held = 0.0, set()
            for f, words in x.items():
                count = Counter(words)
                for w in asked & set(words):
                    held.add(w)
                    idf = math.log(1 + (len(fields) - df[f, w] + 0.5) / (df[f, w] + 0.5))
                    score += idf * count[w] * 2.2 / (count[w] + 1.2 * (0.25 + 0.75 * len(words) / mean[f]))
            if held and (not every or held == asked):
                scores.append((-round(score, 6), cite))
        out |= {(q, cite, -s) for s, cite in sorted(scores)[:k]}
    return out


QUERIES = [(0, "queue kafka"), (1, "ledger audit retry token cache"), (2, "shard"), (3, "é1 a.b x_y queue"), (4, "the of"), (5, "missing word"), (6, "run_3 queue"), (7, "d/f3.py renewed")]


def found(spark, index, k=5, every=False):
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    return {(r.query_id, r.cite, r.score) for r in segments.top_hits(index, asked, k, every).collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)


@pytest.mark.parametrize("small", [segments.SMALL, 0])
def test_hits_equal_plain_loops(spark, tmp_path, small_blocks, monkeypatch, small):
    monkeypatch.setattr(segments, "SMALL", small)
    data = rows(random.Random(1), range(120))
    index = segments.upsert(spark, f"file://{tmp_path}/i", frame(spark, data))
    for k, every in ((1, False), (50, False), (None, True)) if small else ((5, False), (None, False), (3, True)):
        assert found(spark, index, k, every) == plain(data, QUERIES, k, every)


def test_changes_equal_a_rebuilt_index(spark, tmp_path, small_blocks):
    rng, root = random.Random(2), f"file://{tmp_path}/i"
    data = {r[1]: r for r in rows(rng, range(90))}
    segments.upsert(spark, root, frame(spark, list(data.values())), merge=False)
    written = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("segments/**/*") if p.is_file()}
    for part in (0, 1):  # a third of the snippets, twice
        new = {r[1]: r for r in rows(rng, range(part, 90, 3), " renewed")}
        data |= new
        index = segments.upsert(spark, root, frame(spark, list(new.values())), merge=False)
        assert found(spark, index) == plain(list(data.values()), QUERIES, 5)
    gone = [c for k, c in enumerate(data) if k % 7 == 0]
    index = segments.remove(spark, root, spark.createDataFrame([(c,) for c in [*gone, "unknown"]], "cite string"))
    data = {c: r for c, r in data.items() if c not in gone}
    assert found(spark, index) == plain(list(data.values()), QUERIES, 5) and found(spark, index, None, True) == plain(list(data.values()), QUERIES, None, True)
    assert {p: p.stat().st_mtime_ns for p in written} == written and len(index.segments) == 3  # nothing was written again
    assert {r.cite: r.text for r in index.snippets().collect()} == {c: r[0] for c, r in data.items()}
    merged = segments.merge_tiers(spark, root, fan=2)
    assert len(merged.segments) < 3 and found(spark, merged) == plain(list(data.values()), QUERIES, 5)
    old = segments.open_index(spark, root, index.version)
    assert found(spark, old) == plain(list(data.values()), QUERIES, 5)  # a reader of the old version goes on
    segments.vacuum(spark, root, keep=1)
    assert found(spark, segments.open_index(spark, root)) == plain(list(data.values()), QUERIES, 5)
    assert {int(p.name) for p in Path(tmp_path, "i/segments").iterdir()} == set(merged.segments)


def test_many_small_updates_stay_few_segments(spark, tmp_path):
    root, data = f"file://{tmp_path}/i", {}
    for k in range(6):
        new = rows(random.Random(k), range(3 * k, 3 * k + 4))
        data |= {r[1]: r for r in new}
        index = segments.upsert(spark, root, frame(spark, new))
    assert len(index.segments) <= 4 and found(spark, index) == plain(list(data.values()), QUERIES, 5)


def test_odd_updates(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    none = segments.open_index(spark, root)
    assert none.version == -1 and found(spark, none) == set() and none.snippets().collect() == []
    assert segments.upsert(spark, root, frame(spark, [])).version == -1
    twice = [("old text", "c", 0.0, "p", "text", "", "chunk", 1), ("new queue", "c", 0.0, "p", "text", "", "chunk", 2), (None, "n", 0.0, None, None, None, None, 3), ("x", None, 0.0, "p", "text", "", "chunk", 4)]
    index = segments.upsert(spark, root, frame(spark, twice))
    assert {r.cite: r.text for r in index.snippets().collect()} == {"c": "new queue", "n": None}
    assert {(q, c) for q, c, _ in found(spark, index)} == {(0, "c"), (3, "c"), (6, "c")}
    segments.remove(spark, root, spark.createDataFrame([("c",), ("n",)], "cite string"))
    empty = segments.merge_tiers(spark, root)
    assert found(spark, empty) == set() and empty.segments == []
    assert {(q, c) for q, c, _ in found(spark, segments.upsert(spark, root, frame(spark, twice)))} == {(0, "c"), (3, "c"), (6, "c")}


def test_two_writers_of_one_version(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    seen = segments.upsert(spark, root, frame(spark, rows(random.Random(4), range(3))))
    segments.upsert(spark, root, frame(spark, rows(random.Random(5), range(3))))
    with pytest.raises(RuntimeError):
        segments._commit(spark, root, seen, seen.segments, [])


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, small_blocks, monkeypatch):
    data = rows(random.Random(6), range(300))
    index = segments.upsert(spark, f"file://{tmp_path}/i", frame(spark, data))
    kept, real = [], segments.settle

    def watch(df):
        out = real(df)
        if out.columns == ["segment", "block"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(segments, "settle", watch)
    got = segments.top_hits(index, spark.createDataFrame([(0, "queue")], "query_id int, text string"), 1).collect()
    assert {(r.query_id, r.cite, r.score) for r in got} == plain(data, [(0, "queue")], 1)
    assert kept[0] < index.blocks.where("term = 'queue'").count() / 4


@pytest.mark.parametrize("small", [segments.SMALL, 0])
def test_no_row_is_made_for_each_query_and_document(spark, tmp_path, small_blocks, monkeypatch, small):
    monkeypatch.setattr(segments, "SMALL", small)
    monkeypatch.setattr(segments, "CELL", 1_000, raising=False)
    data, root = rows(random.Random(8), range(400)), f"file://{tmp_path}/i"
    segments.upsert(spark, root, frame(spark, data))
    gone = sorted(r[1] for r in data)[::3]
    index = segments.remove(spark, root, spark.createDataFrame([(c,) for c in gone], "cite string"))
    kept, real = [], segments.settle

    def watch(df):
        out = real(df)
        if {"query_id", "doc", "score"} <= set(out.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(segments, "settle", watch)
    assert found(spark, index, 2) == plain([r for r in data if r[1] not in set(gone)], QUERIES, 2)
    assert max(kept) < 300  # a few of each query from each share; documents and queries make more than 1,000


def test_substring_search_builds_no_index(spark, monkeypatch):
    from loam.plans import text_queries

    def asked(*_):
        raise AssertionError("an index was asked for")

    monkeypatch.setattr(text_queries, "stored_index", asked)
    assert text_queries.search_topk(spark, "/root/testdata/sf0.001").count() == 10


def test_postings_are_counted_in_their_documents_row(spark):
    """Counts by plain Python, repeats, single words and empty fields included; nothing is shuffled or hashed for them."""
    held = [["b", "a", "b", "b"], [], ["x"], ["c", "c"], ["z", "y", "z"]]
    docs = spark.createDataFrame([(i, [("body", w), ("symbol", [])]) for i, w in enumerate(held)], "doc long, words array<struct<field:string,terms:array<string>>>")
    found = segments._postings(docs)
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == sorted((w, "body", i, n, len(t)) for i, t in enumerate(held) for w, n in Counter(t).items())


def test_postings_are_sorted_in_ranges_of_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 1_000, raising=False)
    rows = [(f"d:{i}", i, " ".join(f"w{(i * k) % 97}" for k in range(40)), "p", "en", "", "chunk", 0.0) for i in range(200)]
    snippets = spark.createDataFrame(rows, "cite string, pos long, text string, path string, lang string, symbol string, kind string, score double")
    index = segments.upsert(spark, f"file://{tmp_path}/i", snippets)
    assert len(index.blocks.inputFiles()) >= 8  # 8,000 words


def test_blocks_hold_all_postings_and_none_is_shuffled(spark, tmp_path, small_blocks, monkeypatch):
    """What is dealt to write blocks is documents, each once; blocks agree with the postings counted by Spark."""
    monkeypatch.setattr(segments, "RANGE", 500)
    monkeypatch.setattr(segments, "LOT", 7, raising=False)
    dealt, real = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *args, **kw: dealt.append(df) or real(df, *args, **kw))
    data = rows(random.Random(9), range(150))
    index = segments.upsert(spark, f"file://{tmp_path}/i", frame(spark, data))
    assert len(dealt) == 1 and dealt[0].count() == 150
    held = index.blocks.select("block", "term", "field", "n", F.explode("entries").alias("e")).select("block", "term", "field", "n", "e.doc", "e.tf", "e.len")
    want = segments._postings(index.docs).collect()
    assert sorted(map(tuple, held.select("term", "field", "doc", "tf", "len").collect())) == sorted(map(tuple, want)) and len(want) > 500
    sizes = held.groupBy("block", "n").agg(F.count("*").alias("m"), F.count_distinct("term", "field").alias("terms")).collect()
    assert all(r.n == r.m <= 4 and r.terms == 1 for r in sizes) and len(sizes) == index.blocks.count()
