"""Exact top-k inner-product search: ball trees over shards, branch and bound, and a kth score that shards share.

Chunks of queries meet runs of shards. A task holds one chunk and the trees of one run, and carries each query's kth
score from tree to tree; between waves of shards the kth scores of all runs so far meet in a table.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import stage
from loam.llm.vectors import finite, matrix

LEAF = 128
#: Shards are searched in waves that end at these numbers of shards, and then all others at once.
WAVES = (1, 8, 64)
#: A task holds the trees of so many shards at most.
RUN = 8
#: Below every score; its negative is a long too.
LEAST = np.iinfo(np.int64).min + 1


def scaled(vector: Column, scale: int = 64) -> Column:
    """The components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


@dataclass
class BallTree:
    """Rows in tree order; node i covers rows ``low[i]`` to ``high[i]``, all within ``radius[i]`` of ``center[i]``.

    ``order`` says where each row stood before.
    """

    ids: np.ndarray
    order: np.ndarray
    rows: np.ndarray
    low: list[int]
    high: list[int]
    children: list[tuple[int, int] | None]
    center: np.ndarray
    radius: np.ndarray


def build_tree(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Halve the rows at the median of the component of largest spread until ``leaf`` or fewer are left."""
    order, low, high, children = np.arange(len(ids)), [0], [len(ids)], [None]
    at = 0
    while at < len(low):
        lo, hi = low[at], high[at]
        if hi - lo > leaf:
            own = order[lo:hi]
            spread = rows[own].var(0, dtype=np.float64)
            mid = (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(rows[own, spread.argmax()], mid)]
            children[at] = (len(low), len(low) + 1)
            low += [lo, lo + mid]
            high += [lo + mid, hi]
            children += [None, None]
        at += 1
    ids, rows = ids[order], rows[order]
    center = np.stack([rows[a:b].mean(0, dtype=np.float64) for a, b in zip(low, high)])
    radius = np.array([np.sqrt(((rows[a:b] - c) ** 2.0).sum(1).max()) for a, b, c in zip(low, high, center)])
    return BallTree(ids, order, rows, low, high, children, center, radius)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats while they hold the sums exactly, else by Python's integers."""
    largest = lambda m: float(max(-int(m.min(initial=0)), int(m.max(initial=0))))
    most = largest(q) * largest(x) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, LEAST + 1, 2**63 - 1).astype(np.int64)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the scores and places in the tree of the shard's k best rows that reach ``floor``.

    Places left over score LEAST. Of equal scores the smaller id comes first.

    Nodes are visited in order of their upper bound ``q . center + |q| radius`` over the queries that still need
    them. A query skips a node whose bound is below its kth score so far; at an equal bound a smaller id may wait.
    """
    width = max(queries.shape[1], tree.rows.shape[1])
    fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    queries, rows, center = fill(queries), fill(tree.rows), fill(tree.center)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    bound = queries.astype(np.float64) @ center.T + norm[:, None] * tree.radius[None]
    bound += 1e-9 * np.abs(bound) + 1e-6
    best, places = np.full((len(ids), k), LEAST), np.full((len(ids), k), -1)
    owners = np.append(tree.ids, np.iinfo(np.int64).max)  # place -1 is nobody's
    kth = floor.copy()
    heap = [(-bound[:, 0].max(), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(bound[:, node] >= kth)
        if not len(active):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                heapq.heappush(heap, (-bound[active, child].max(), child))
            continue
        a, b = tree.low[node], tree.high[node]
        scores = _products(queries[active], rows[a:b])
        scores[ids[active][:, None] == tree.ids[None, a:b]] = LEAST
        useful = (scores >= np.maximum(kth[active], LEAST + 1)[:, None]).any(1)
        active, scores = active[useful], scores[useful]
        if not len(active):
            continue
        scores = np.concatenate([best[active], scores], 1)
        place = np.concatenate([places[active], np.broadcast_to(np.arange(a, b), (len(active), b - a))], 1)
        first = np.lexsort((owners[place], -scores), axis=1)[:, :k]
        best[active], places[active] = np.take_along_axis(scores, first, 1), np.take_along_axis(place, first, 1)
        kth[active] = np.maximum(kth[active], best[active, -1])
    return best, places


def _width(vectors: pa.ChunkedArray) -> int:
    return max(1, int(np.asarray(vectors.combine_chunks().value_lengths()).max()))


def _plant(group: pa.Table) -> pa.Table:
    """One shard's tree, its components in the smallest integers that hold them."""
    rows = matrix(group.column("vector"), _width(group.column("vector")), np.int64)
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    tree = build_tree(group.column("vec_id").to_numpy(), rows.astype(kind))
    made = pickle.dumps((tree, group.column("row").to_numpy()[tree.order]))
    return pa.table({"shard": group.column("shard")[:1], "tree": pa.array([made], pa.binary())})


_FOUND = [("q", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 16_384, chunk_rows: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` rows of highest integer inner product.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows but those of the query's own
    id; ties go to the smaller id. Components count as ``floor(64 * x)``. Candidates fall by hash into shards of
    about ``shard_rows``, each a ball tree; queries into chunks of at most about ``chunk_rows``. A chunk meets its
    shards in waves (``WAVES``), each in runs of at most ``RUN`` shards, a task each. A query's kth score passes from
    tree to tree inside a run, and the kth over all runs so far is where the next wave begins. Trees are copied once
    a chunk, so shuffle grows with candidates times chunks; scores grow with candidates times queries where the
    bounds do not prune.

    Edge cases: vectors that are null or hold a null or non-finite component and rows without ``vec_id`` take no
    part; a shorter vector's missing components count as 0; repeated candidate rows count each; a query id with
    several vectors has one list, in which each candidate row stands once, with its best score; a query with fewer
    than ``k`` candidates gets them all; an empty table gives no rows. No parameter but ``k`` and ``every`` changes
    the result.
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    rows = good.select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "integers")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards = max(1, -(-n // shard_rows))
    chunks = max(1, -(-queries // chunk_rows), min(2 * spark.sparkContext.defaultParallelism, -(-queries // 256)))
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_plant, "shard int, tree binary")
    trees = stage(trees, "trees")
    distinct = asked.groupBy("vec_id", "vector").agg(F.min("row").alias("q"))
    asking = stage(distinct.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")), "queries")
    numbers = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1)))
    everywhere = trees.withColumn("chunk", numbers(chunks)).withColumn("place", F.pmod(F.col("shard") - F.col("chunk"), F.lit(shards)))
    waves, done, floors = [], 0, asking.select("q", F.lit(LEAST).alias("floor"))
    for end in sorted({*(w for w in WAVES if w < shards), shards}):
        right = everywhere.where((F.col("place") >= done) & (F.col("place") < end)).withColumn("run", F.floor((F.col("place") - done) / RUN).cast("int"))
        left = asking.join(floors, "q").withColumn("run", numbers(-(-(end - done) // RUN)))
        found = left.groupBy("chunk", "run").cogroup(right.groupBy("chunk", "run")).applyInArrow(_searcher(k), "q long, query_id long, row long, vec_id long, score long")
        waves.append(found)
        if end < shards:
            waves[-1] = stage(found, f"wave{end}")
            seen = reduce(DataFrame.unionAll, waves).groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
            floors = asking.select("q").join(seen, "q", "left").select("q", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(LEAST)).alias("floor"))
            done = end
    hits = reduce(DataFrame.unionAll, waves).groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(k: int):
    """Searches one chunk's queries in the trees of one run: at most ``k`` hits a query that reach its kth score."""

    def run(asking: pa.Table, trees: pa.Table) -> pa.Table:
        if not asking.num_rows or not trees.num_rows:
            return pa.table([pa.array([], t) for _, t in _FOUND], names=[c for c, _ in _FOUND])
        ids, floor = asking.column("vec_id").to_numpy(), asking.column("floor").to_numpy().copy()
        queries = matrix(asking.column("vector"), _width(asking.column("vector")), np.int64)
        best, who, which = np.full((len(ids), k), LEAST), np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -1)
        for made in trees.column("tree"):
            tree, numbers = pickle.loads(made.as_py())
            for at in range(0, len(ids), 512):  # few enough that their scores of a leaf stay small
                part = slice(at, at + 512)
                scores, places = search(tree, ids[part], queries[part], floor[part], k)
                scores, owner, row = np.concatenate([best[part], scores], 1), np.concatenate([who[part], tree.ids[places]], 1), np.concatenate([which[part], numbers[places]], 1)
                first = np.lexsort((row, owner, -scores), axis=1)[:, :k]
                best[part], who[part], which[part] = (np.take_along_axis(x, first, 1) for x in (scores, owner, row))
                floor[part] = np.maximum(floor[part], best[part, -1])
        i, j = np.nonzero((best > LEAST) & (best >= floor[:, None]))
        columns = [asking.column("q").to_numpy()[i], ids[i], which[i, j], who[i, j], best[i, j]]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND)], names=[c for c, _ in _FOUND])

    return run
