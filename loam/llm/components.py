"""Connected components of an edge table by alternating large and small stars.

Each round is two joins and two aggregations over the edge table; hubs only ever meet a join, which adaptive
execution splits, or an aggregation with map-side combine. Nothing but a flag reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; ``root`` is the smallest node it can reach.

    ``edges`` has two columns of one orderable type, in any direction, repeats and loops allowed. Edges with a null
    end are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    linked = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = linked.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    pairs = stage(pairs.distinct(), "edges")
    while not _stars(pairs):
        pairs, before = stage(_small_star(_large_star(pairs)), "edges"), pairs
        discard(before)
    root = pairs.select("lo").distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(root.select("lo", "lo"))


def _stars(pairs: DataFrame) -> bool:
    """Whether every node is either a root or hangs on one root directly."""
    ends = pairs.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        pairs.select("lo", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(pairs.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    grown = both.where(F.col("v") > F.col("u")).join(least, "u")
    return grown.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = pairs.join(least, "hi").where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def stars(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hang each node of a boolean adjacency matrix on the smallest id of its component."""
    open_, edges = near.any(1), []
    while open_.any():
        front = np.array([int(open_.argmax())])
        member = np.zeros(len(ids), bool)
        member[front] = True
        while len(front):
            front = np.flatnonzero(near[front].any(0) & ~member)
            member[front] = True
        open_ &= ~member
        root = int(ids[member].min())
        edges += [(int(x), root) for x in ids[member] if x != root]
    return edges
