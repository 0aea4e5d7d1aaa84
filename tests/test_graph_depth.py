"""Reachability and strong components on deep graphs: few rounds, nothing left behind, the same rows as plain loops."""

import random
import time
from pathlib import Path

import pytest

from loam.functions import lineage
from loam.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in pairs], "src string, dst string")


def plain_reach(pairs, seeds):
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    out = set()
    for s in seeds:
        seen, open_ = {s}, [s]
        while open_:
            for b in ways.get(open_.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        out |= {(s, x) for x in seen - {s}}
    return out


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    far = plain_reach(pairs, nodes)
    on_cycle = {a for a, b in pairs if a == b} | {a for a, b in pairs if (b, a) in far}
    return {(a, min([a, *(b for b in nodes if (a, b) in far and (b, a) in far)])) for a in on_cycle}


def named(rows):
    return {(f"n{a:05}", f"n{b:05}") for a, b in rows}


def shapes():
    rng = random.Random(11)
    ring = [(i, (i + 1) % 40) for i in range(40)]
    yield ring + [(100, 3), (7, 200), (200, 201), (101, 100)]
    yield [*((i, i + 1) for i in range(30)), (9, 4), (22, 17), (22, 20), (15, 15)]
    yield [(50, 1), (1, 60), (60, 2), (2, 50), (60, 70), (70, 3), (3, 60), (3, 3), (80, 0), (0, 90), (90, 80)]
    yield [(0, 1), (1, 5), (0, 2), (2, 5), (5, 6), (6, 0), (6, 7), (7, 6)]
    yield [(i, (i - 1) // 2) for i in range(1, 60)]
    for n in (20, 35):
        yield sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(n + n // 3)})
    yield sorted({(i, rng.randrange(60)) for i in range(60)})


def test_many_shapes(spark):
    """All shapes in one graph, side by side."""
    pairs = [(a + 1000 * k, b + 1000 * k) for k, shape in enumerate(shapes()) for a, b in shape]
    e = edges(spark, pairs)
    assert {tuple(r) for r in graph.strong_components(e).select("node", "scc").collect()} == named(plain_components(pairs))
    seeds = sorted({a for a, _ in pairs})[::3] + [99_999]
    ids = spark.createDataFrame([(f"n{s:05}",) for s in seeds], "id string")
    assert {tuple(r) for r in graph.reach(e, ids, forward=False, hops=2).collect()} == named(plain_reach([(b, a) for a, b in pairs], seeds))


def test_no_edges(spark):
    e, ids = edges(spark, []), spark.createDataFrame([("a",)], "id string")
    assert graph.reach(e, ids).collect() == [] and graph.strong_components(e).collect() == []
    loop = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert [tuple(r) for r in graph.strong_components(loop).collect()] == [("a", "a")] and graph.reach(loop, ids).collect() == []


@pytest.fixture
def rounds(monkeypatch):
    """Counts tables written."""
    made = []
    for name in ("stage", "settle"):
        real = getattr(lineage, name)
        monkeypatch.setattr(graph, name, lambda df, real=real: made.append(1) or real(df))
    return made


@pytest.mark.parametrize("closed", [False, True])
def test_components_of_a_thousand_in_a_row(spark, rounds, closed):
    pairs = [(i, i + 1) for i in range(1000)] + [(1000, 0)] * closed
    got = graph.strong_components(edges(spark, pairs)).collect()
    assert {tuple(r) for r in got} == ({(f"n{i:05}", "n00000") for i in range(1001)} if closed else set())
    assert len(rounds) <= 30


def test_reach_along_a_thousand(spark, rounds):
    began = time.time()
    e = edges(spark, [(i, i + 1) for i in range(1000)])
    ids = spark.createDataFrame([(f"n{i:05}",) for i in range(1001)], "id string")
    found = graph.ancestors(e, ids)
    assert found.count() == 1000 * 1001 // 2 and found.where("seed = node or seed < node").isEmpty()
    assert time.time() - began < 60 and len(rounds) <= 60


def test_rounds_leave_no_tables(spark):
    shared = Path(lineage.shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("stage-*"))
    e = edges(spark, [(i, i + 1) for i in range(30)] + [(20, 10), (12, 11)])
    graph.reach(e, spark.createDataFrame([("n00000",)], "id string")).collect()
    left = {p for p in set(shared.glob("stage-*")) - before if any(p.rglob("*.parquet"))}
    assert len(left) <= 2  # what the lazy result reads


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """No join of a round is a broadcast, which would pass the driver once a round."""
    plans, stage = [], graph.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(graph, "stage", seen)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "src string, dst string")
    got = graph.reach(edges, edges.limit(1).selectExpr("'n0' as id"))
    assert {r.node for r in got.collect()} == {"n1", "n2", "n3", "n4"}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
