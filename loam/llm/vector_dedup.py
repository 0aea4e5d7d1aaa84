"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, and an exact cosine check.

Two bounds make the search lossless, however well the quantiser fits. Unit vectors of cosine ``c`` lie
``r = sqrt(2 - 2c)`` apart, so a vector can only link into a list whose bisecting plane with its own list is within
``r`` of it; all such lists are probed. And a table-lookup distance differs from the true one by at most the coded
vector's own quantisation error, which is kept with its code.

Probes carry four bits a component, and how far that is from the vector, which only widens the bounds. Whole vectors are
fetched once some pair of theirs has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import stage
from loam.llm.components import connected_components, stars
from loam.llm.vectors import finite, matrix

EPS = 1e-6
CODES = 256


@dataclass
class Quantiser:
    """Centroids of the coarse lists, and codebooks (subspace, code, component) of residuals."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; where there are fewer rows than means, the rows themselves, repeated."""
    c = x[rng.permutation(len(x))[:k]] if len(x) > k else np.resize(x, (k, x.shape[1]))
    for _ in range(rounds if len(x) > k else 0):
        near = _square(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit_quantiser(x: np.ndarray, lists: int, subspaces: int = 8) -> Quantiser:
    """Fit on unit vectors ``x``; the width is filled up to a multiple of ``subspaces``."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % subspaces)))
    rng = np.random.default_rng(4)
    centroids = _means(x, min(lists, len(x)), 8, rng)
    left = (x - centroids[_square(x, centroids).argmin(1)]).reshape(len(x), subspaces, -1)
    return Quantiser(centroids, np.stack([_means(left[:, m], CODES, 6, rng) for m in range(subspaces)]))


def _encode(q: Quantiser, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and how far each residual is from what its code stands for."""
    parts = residual.reshape(len(residual), len(q.books), -1)
    codes = np.stack([_square(parts[:, m], q.books[m]).argmin(1) for m in range(len(q.books))], 1).astype(np.uint8)
    coded = np.stack([q.books[m][codes[:, m]] for m in range(len(q.books))], 1)
    return codes, np.sqrt(((parts - coded) ** 2).sum((1, 2)))


def _lookup(q: Quantiser, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Asymmetric distances: of each query's residual to what each code stands for, summed from tables."""
    parts = residual.reshape(len(residual), len(q.books), -1)
    total = np.zeros((len(residual), len(codes)))
    for m in range(len(q.books)):
        total += _square(parts[:, m], q.books[m])[:, codes[:, m]]
    return np.sqrt(total)


def _shorten(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four bits a component in two to a byte, the step between them, and how far that is from each row."""
    step = (np.abs(x).max(1) / 7).astype(np.float32)
    whole = np.rint(x / step[:, None].astype(float)).astype(np.int64)
    blur = np.sqrt(((x - whole * step[:, None].astype(float)) ** 2).sum(1))
    return ((whole[:, ::2] + 8) << 4 | whole[:, 1::2] + 8).astype(np.uint8), step, blur


def _lengthen(short: np.ndarray, step: np.ndarray) -> np.ndarray:
    whole = np.stack([short >> 4, short & 15], 2).reshape(len(short), -1).astype(float) - 8
    return whole * step[:, None].astype(float)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a unit that are compared with one another, and whether each pair of them stands there twice."""
    left = group.column("left").to_numpy().astype(bool)
    alone = not group.column("asked")[0].as_py() and group.column("a")[0].as_py() == group.column("b")[0].as_py()
    return np.flatnonzero(left), np.arange(len(left)) if alone else np.flatnonzero(~left), alone


#: Keys of lists up to this many (label, length, list, two numbers each) go to every executor whole; more are joined.
SMALL_KEYS = 200_000
#: Into so many pieces is each list dealt where keys are joined, so that no list stays in one task.
SALT = 64
UNIT = ["key", "a", "b", "asked"]


def near_vectors(
    embeddings: DataFrame, cosine: float = 0.98, sample: int = 20_000, subspaces: int = 8, chunk: int = 1024, small_keys: int = SMALL_KEYS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (``vec_id, embedding, label``).

    Vectors of one label and length link where their cosine, in double precision, is at least ``cosine``. Equal
    vectors are compared once and counted as often as they occur. The quantiser is fitted on the ``sample`` vectors
    of smallest hash, with about sqrt(n) lists for the n vectors of the most frequent label, a quarter of the sample
    at most; every vector is indexed. Lists and queries meet in chunks of about ``chunk`` vectors, so a task never
    holds more than two chunks. A first pass over codes names the members of each pair of chunks that may have a
    partner there; a second one compares those by their vectors, and returns at most an edge and a count a member.

    Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label
    or ``vec_id``, link with nothing; rows that repeat a ``vec_id`` with other vectors share its links and component;
    a row without ``vec_id`` has no component and is not kept; an empty table gives no rows; other columns are ignored.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    good = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good)
    reps = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = stage(reps.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    most, width = reps.groupBy("label").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).agg(F.max("n"), F.max("dim")).first()
    if not most:
        none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.col("vec_id").isNotNull())
    chosen = reps.orderBy(F.xxhash64("embedding"), "rep").limit(sample).select("embedding").toArrow()
    q = fit_quantiser(_unit(matrix(chosen.column("embedding"), width)), max(1, min(sample // 4, round(sqrt(most)))), subspaces)
    reach = sqrt(2 - 2 * cosine) + EPS
    between = np.sqrt(_square(q.centroids, q.centroids))
    carried = ["label", "dim", "row"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column("embedding"), q.width))
            far = _square(x, q.centroids)
            own = far.argmin(1)
            codes, error = _encode(q, x - q.centroids[own])
            short, step, blur = _shorten(x)
            at = np.arange(len(x))
            probes = far - far[at, own][:, None] <= 2 * reach * between[own] + EPS
            probes &= np.arange(far.shape[1]) > own[:, None]  # of two lists the smaller one's vector asks
            row, to = np.nonzero(probes)
            both = np.concatenate([at, row])
            columns = [batch.column(c).take(pa.array(both)) for c in carried]
            columns += [pa.array(np.concatenate([own, to]), pa.int32()), pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary())]
            columns += [pa.array([c.tobytes() for c in short], pa.binary()).take(pa.array(both))]
            columns += [pa.array(x, pa.float32()) for x in (np.concatenate([error, np.zeros(len(row))]), step[both], blur[both])]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "list", "codes", "short", "error", "step", "blur"])

    kind = {f.name: f.dataType.simpleString() for f in reps.schema.fields}
    ddl = ", ".join(f"{c} {kind[c]}" for c in carried) + ", list int, codes binary, short binary, error float, step float, blur float"
    entries = stage(reps.select(*carried, "embedding").mapInArrow(index, ddl), "lists")
    sizes = entries.groupBy("label", "dim", "list").agg(F.count("codes").alias("data"), F.count_if(F.col("codes").isNull()).alias("asking"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / chunk).cast("int"))
    sizes = sizes.where("data > 0 and data + asking > 1").select("label", "dim", "list", parts("data").alias("p"), parts("asking").alias("q"), "asking")
    sizes = stage(sizes.withColumn("key", F.monotonically_increasing_id()), "keys")
    on = ["label", "dim", "list"]
    if sizes.count() <= small_keys:
        known = entries.join(F.broadcast(sizes), on)
    else:
        salted = entries.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
        known = salted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "salt"])
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["left", "row", "list", "codes", "short", "error", "step", "blur"]
    own = known.where("codes is not null").withColumn("part", part("p"))
    a, b = F.least("part", "other"), F.greatest("part", "other")
    inside = own.withColumn("other", numbers("p")).select("*", a.alias("a"), b.alias("b"), F.lit(False).alias("asked"), (F.col("part") == a).alias("left"))
    shown = own.where("asking > 0").select("*", F.col("part").alias("a"), numbers("q").alias("b"), F.lit(True).alias("asked"), F.lit(True).alias("left"))
    asks = known.where("codes is null").withColumn("part", part("q"))
    asks = asks.select("*", numbers("p").alias("a"), F.col("part").alias("b"), F.lit(True).alias("asked"), F.lit(False).alias("left"))
    met = reduce(DataFrame.unionAll, [x.select(*UNIT, *held) for x in (inside, shown, asks)])

    def sift(group: pa.Table) -> pa.Table:
        """The members that may have a partner, by table-lookup distances and then by the short vectors themselves."""
        one, two, alone = _sides(group)
        some = np.zeros(group.num_rows, bool)
        if len(one) and len(two):
            error, blur = (group.column(c).to_numpy().astype(float) + EPS for c in ("error", "blur"))
            x = _lengthen(_bytes(group.column("short")), group.column("step").to_numpy())
            asked = x[two] - q.centroids[group.column("list")[0].as_py()]
            near = _lookup(q, asked, _bytes(group.column("codes").take(pa.array(one)))) <= reach + error[one] + blur[two][:, None]
            j, i = np.nonzero(near)
            i, j = one[i], two[j]
            i, j = (i[i < j], j[i < j]) if alone else (i, j)
            for at in range(0, len(i), 100_000):
                s, t = i[at : at + 100_000], j[at : at + 100_000]
                close = np.sqrt(((x[s] - x[t]) ** 2).sum(1)) <= reach + blur[s] + blur[t]
                some[s[close]] = some[t[close]] = True
        return group.select([*UNIT, "left", "row"]).filter(pa.array(some))

    kept = stage(met.groupBy(*UNIT).applyInArrow(sift, "key long, a int, b int, asked boolean, left boolean, row long"), "sifted")
    whole = kept.join(reps.select("row", "rep", "n", "embedding"), "row")

    def compare(group: pa.Table) -> pa.Table:
        one, two, alone = _sides(group)
        x, rep, n = matrix(group.column("embedding"), q.width), group.column("rep").to_numpy(), group.column("n").to_numpy()
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])  # by powers of two, so that no square leaves the range of doubles
        norm = np.sqrt((x * x).sum(1))
        near = np.zeros((len(x), len(x)), bool)
        near[np.ix_(one, two)] = np.stack([x[two] @ x[i] / (norm[two] * norm[i]) >= cosine for i in one]) if len(one) and len(two) else False
        np.fill_diagonal(near, False)
        near |= near.T
        links = (near @ n.astype(np.float64)).astype(np.int64)
        some = np.flatnonzero(links)
        edges = np.array(stars(near, rep), np.int64).reshape(-1, 2)
        ids = np.concatenate([rep[some], edges[:, 0]])
        to = pa.array(np.concatenate([np.zeros(len(some), np.int64), edges[:, 1]]), pa.int64(), mask=np.arange(len(ids)) < len(some))
        return pa.table({"rep": pa.array(ids, pa.int64()), "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]), "to": to})

    found = stage(whole.groupBy(*UNIT).applyInArrow(compare, "rep long, links long, to long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("to is not null").select("rep", "to")).withColumnsRenamed({"node": "rep", "root": "component_id"})
    known = reps.join(links, "rep", "left").join(groups, "rep", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component_id", "rep").alias("component"),
    )
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
