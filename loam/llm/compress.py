"""Vector codes: whole-number product quantisation by Lloyd rounds, nearest entries found through a GNAT.

Each round is one scan in which tasks add up the parts nearest to every entry; what reaches the driver is one row for
each entry of the codebooks. Entries stand in a geometric near-neighbour access tree: split points keep the range of
their distances to each other split's entries, and a query's distance to a split rules out whole subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import join_groups, stage
from loam.llm.vectors import finite, matrix

PARTS = 4
#: Whole numbers up to this stay exact as doubles through a squared distance of that many components.
EXACT = 1 << 53
SCALE = 1024


@dataclass
class Node:
    """Split points, and for each one's other entries: a subtree or the entries themselves, and distance ranges.

    ``low[i, j]`` and ``high[i, j]`` bound the distances of split ``i`` to the entries below split ``j``.
    """

    splits: np.ndarray
    below: list[Node | np.ndarray] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def exact(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squared distances between rows of whole numbers are exact in doubles."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    return 4 * largest**2 * x.shape[1] < EXACT


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``: by products for doubles, entry by entry for whole numbers."""
    if x.dtype == float:
        return (x * x).sum(1)[:, None] + ((c * c).sum(1)[None] - 2 * (x @ c.T))
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


class Gnat:
    """Nearest entries of a codebook of whole numbers: the smallest squared distance, ties to the smallest index."""

    def __init__(self, entries: np.ndarray, degree: int = 16) -> None:
        self.entries, self.degree = entries, degree
        self.kinds = {np.dtype(np.int64): entries, np.dtype(float): entries.astype(float)}
        self.root = self._build(np.arange(len(entries)))
        self.measured = 0  # distances computed so far

    def _build(self, ids: np.ndarray) -> Node | np.ndarray:
        """A subtree over ``ids``, which are in order, as are all lists of entries in it."""
        if len(ids) <= self.degree:
            return ids
        chosen = [0]  # split points spread out: each next one is farthest from those before it
        far = squares(self.entries[ids], self.entries[ids[:1]])[:, 0]
        while len(chosen) < self.degree and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, squares(self.entries[ids], self.entries[ids[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # nothing but copies of one entry, of which the first wins every tie
            return ids[:1]
        splits, rest = np.sort(ids[chosen]), np.delete(ids, chosen)
        distance = squares(self.entries[splits], self.entries[rest])
        own = distance.argmin(0)
        root = np.sqrt(distance.astype(float))
        node = Node(splits, low=np.full((len(splits),) * 2, np.inf), high=np.full((len(splits),) * 2, -np.inf))
        for j in range(len(splits)):
            mine = own == j
            node.below.append(self._build(rest[mine]))
            if mine.any():
                node.low[:, j], node.high[:, j] = root[:, mine].min(1), root[:, mine].max(1)
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entry and squared distance, both whole numbers."""
        x = x.astype(float) if exact(x, self.entries) else x
        best = np.full(len(x), np.inf if x.dtype == float else np.iinfo(np.int64).max, x.dtype)
        entry = np.full(len(x), len(self.entries))
        self._search(self.root, x, np.arange(len(x)), best, entry)
        return entry, best.astype(np.int64)

    def _take(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Measure entries ``ids``; distances are whole numbers, so a tie is a tie and goes to the smaller index."""
        found = squares(x[rows], self.kinds[x.dtype][ids])
        self.measured += found.size
        first = found.argmin(1)
        least, index = found[np.arange(len(rows)), first], ids[first]
        better = (least < best[rows]) | (least == best[rows]) & (index < entry[rows])
        best[rows[better]], entry[rows[better]] = least[better], index[better]
        return found

    def _search(self, node: Node | np.ndarray, x: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._take(node, x, rows, best, entry)
            return
        found = self._take(node.splits, x, rows, best, entry)
        own, distance = found.argmin(1), np.sqrt(found.astype(float))
        for j, child in enumerate(node.below):  # the nearest split's entries first: they make the radius small
            self._search(child, x, rows[own == j], best, entry)
        reach = np.sqrt(best[rows].astype(float))
        for j, child in enumerate(node.below):
            if not np.isfinite(node.low[0, j]):
                continue
            # Strictly farther than the best so far, by more than the roundings of the roots, at any split: what may tie stays.
            apart = np.maximum(distance - node.high[:, j], node.low[:, j] - distance) - 1e-12 * (distance + node.high[:, j])
            self._search(child, x, rows[(apart.max(1) <= reach * (1 + 1e-12)) & (own != j)], best, entry)


def limit(width: int) -> int:
    """The largest whole number that components are held to, so that a row's error fits 64 bits."""
    return 1 << ((62 - max(1, width).bit_length()) // 2 - 1)


def whole(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as ``floor(SCALE * x)`` by row and component; shorter vectors are filled up with zeros."""
    most = limit(width)
    return np.clip(np.floor(matrix(column, width) * SCALE), -most, most).astype(np.int64)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, 1)


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> list[list[tuple[int, list[int]]]]:
    """By part and entry: how many parts are nearest to it, and their sum by component."""
    trees, part = [Gnat(b) for b in books], width // PARTS
    names = [f"s{k}" for k in range(part)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), part), np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(whole(batch.column("embedding"), width))):
                entry, _ = trees[p].nearest(x)
                count[p] += np.bincount(entry, minlength=len(books[p]))
                np.add.at(total[p], entry, x)
        p, e = np.nonzero(count)
        columns = [pa.array(c, pa.int64()) for c in (p, e, count[p, e], *total[p, e].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

    ddl = ", ".join(f"{c} long" for c in ("part", "entry", "n", *names))
    exact = [F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names]
    found = rows.mapInArrow(add, ddl).groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)
    out: list[list] = [[None] * len(b) for b in books]
    for r in found.collect():  # a row an entry
        out[r["part"]][r["entry"]] = (r["n"], [int(r[c]) for c in names])
    return out


def fit_codebooks(rows: DataFrame, width: int, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """A codebook for each part: the parts of the ``entries`` rows of smallest id, moved by ``rounds`` Lloyd rounds.

    Sums are exact; an entry becomes the floor of the mean of the parts nearest to it, and stays where none is.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    books = _parts(whole(first.column("embedding"), width))
    for _ in range(rounds):
        sums = _sums(rows, books, width)
        books = [np.array([[s // x[0] for s in x[1]] if x else old.tolist() for x, old in zip(found, book)], np.int64).reshape(book.shape) for found, book in zip(sums, books)]
    return books


def signature(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int, carried: list[str]) -> DataFrame:
    """``carried`` columns, ``code`` (two hex digits a part) and ``error``, the squared distances summed over parts."""
    trees = [Gnat(b) for b in books]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.nearest(x) for t, x in zip(trees, _parts(whole(batch.column("embedding"), width)))]
            text = [bytes(c).hex() for c in np.stack([e for e, _ in found], 1).astype(np.uint8)]
            columns = [batch.column(c) for c in carried] + [pa.array(text, pa.string()), pa.array(sum(d for _, d in found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "code", "error"])

    return rows.mapInArrow(code, ", ".join(f"{c} {kind[c]}" for c in carried) + ", code string, error long")


def compress_vectors(embeddings: DataFrame, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row of ``embeddings`` (``vec_id, embedding, label``).

    Rows whose vector is null or holds a null or non-finite component are dropped. ``label_error`` is the sum of
    ``error`` over the rows of the same label, null ones together. ``entries`` is at most 256.

    Edge cases: fewer rows than ``entries`` make smaller codebooks; rows without ``vec_id`` come last among the first
    entries, and rows that repeat one by their vectors; vectors are filled up with zeros to the longest one's length
    and that to a multiple of four, and empty ones are zero; whole numbers beyond ``limit(width)`` (1.3e8, components
    of 131,072, at 64 components) are held there, so that every error fits 64 bits; an empty table gives no rows; other
    columns are ignored.
    """
    rows = embeddings.select("vec_id", "embedding", "label").where(finite(F.col("embedding")))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    width = -(-(longest or 1) // PARTS) * PARTS
    books = fit_codebooks(rows, width, entries, rounds) if longest is not None else [np.zeros((1, 1), np.int64)] * PARTS
    coded = stage(encode(rows, books, width, ["vec_id", "label"]), "codes")
    labels = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    key: Column = F.lit(signature(books))
    return join_groups(coded, labels, ["label"], "n").select("vec_id", "code", "error", "label_error", key.alias("codebooks_sha256"))
