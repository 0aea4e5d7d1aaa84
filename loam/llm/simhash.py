"""SimHash near-duplicates: pigeonhole blocks, a join on block keys, and a Hamming check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, floor, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from loam.llm.common import small_batches, stage
from loam.llm.components import connected_components, stars

SEED = 42
SHINGLE = 3
#: Fingerprints are hashed and summed in pieces of this many shingles, so that one huge text needs little memory.
PIECE = 1 << 16


def _majorities(text: str | None, shingle: int, copies: int, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """``64 * copies`` bits, each set if it is in over half the shingles' hashes, and the number of shingles.

    The first 64 are those of the hashes themselves; each further copy mixes them anew. The hashes join ``seen``.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(64 * copies, bool), 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64 * copies, np.int64)
    for at in range(0, n, PIECE // copies):
        part = words[at : at + PIECE // copies + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], "<u8")
        if seen is not None:
            seen.append(hashes)
        bits = np.unpackbits(_mixed(hashes, copies).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # what a byte can count
            ones += bits[low : low + 255].sum(0, dtype=np.uint8)
    return ones * 2 > n, n


def _mixed(hashes: np.ndarray, copies: int) -> np.ndarray:
    """The hashes and ``copies - 1`` mixtures of each, row by row."""
    out = hashes[:, None] + np.arange(copies, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    more = out[:, 1:]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        more ^= more >> np.uint64(shift)
        more *= np.uint64(factor)
    more ^= more >> np.uint64(31)
    return np.ascontiguousarray(out)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles, unsigned; 0 when there are no words."""
    return int(np.packbits(_majorities(text, shingle, 1)[0], bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


def _block_keys(fp: Column, distance: int, extra: int) -> Column:
    """Keys of which two fingerprints within ``distance`` bits share at least one.

    The bits fall into ``distance + extra`` blocks; differing bits touch at most ``distance`` of them, so some
    ``extra`` blocks agree, and each choice of ``extra`` blocks makes a key.
    """
    n = distance + extra
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for tag, chosen in enumerate(combinations(range(n), extra)):
        key = F.lit(tag).cast("long")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            bits = F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints within ``distance`` bits to their components: a star for each."""
    near = np.empty((len(fps), len(fps)), bool)
    bits = fps.view(np.uint64)
    for at in range(0, len(fps), 256):
        near[at : at + 256] = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance
    np.fill_diagonal(near, False)
    return stars(near, fps)


def _compared(keyed: DataFrame, forest: Callable[[list], list[tuple[int, int]]], chunk: int, rare: bool) -> DataFrame:
    """The distinct edges ``(src, dst)`` that ``forest`` finds among the values ``fp`` of each ``key``.

    A key of more than ``chunk`` values is dealt out as pairs of chunks, so that no task holds more than two chunks of
    one key. Others are a group as they stand, gathered in one shuffle; where most keys have one value alone (``rare``),
    a join leaves out those first. Each group returns at most one edge a member, however many pairs are close.
    """
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > (1 if rare else chunk)), "shared")
    parts = F.ceil(F.col("n") / chunk)
    members = keyed.join(shared, "key").select("key", "fp", F.pmod(F.xxhash64("fp"), parts).alias("part"), parts.alias("parts"))
    dealt = members.select("key", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    unit = F.struct("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    groups = dealt.groupBy(unit.alias("unit")).agg(F.collect_list("fp").alias("fps")).select("fps")
    if not rare:
        some = not shared.isEmpty()
        cold = keyed.join(shared.select("key"), "key", "left_anti") if some else keyed
        small = cold.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        groups = groups.unionAll(small) if some else small
    return _edges(groups, forest)


def _edges(groups: DataFrame, forest: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """The distinct edges ``(src, dst)`` that ``forest`` finds in each list ``fps``."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [e for fps in batch["fps"] for e in forest(list(fps))]
            yield pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["src", "dst"])

    return groups.mapInPandas(verify, "src long, dst long").distinct()


def near_edges(fps: DataFrame, distance: int = 3, extra: int | None = None, chunk: int = 1024) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all pairs within ``distance`` bits.

    ``fps`` has distinct fingerprints in its column ``fp`` (long). Keys are made of ``extra`` blocks, of one more for
    each 2^24 times as many fingerprints, so that few unrelated ones share a key; the edges are the same for each.
    """
    extra = extra or 2 + max(0, fps.count().bit_length() - 2) // 24
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"), distance, extra)).alias("key"))
    return _compared(keyed, lambda fps: _forest(np.array(fps, np.int64), distance), chunk, True)


def simhash_groups(docs: DataFrame, distance: int = 3) -> DataFrame:
    """Each row's SimHash and its near-duplicate group: ``doc_id, fingerprint, component_id``.

    Fingerprints of at most ``distance`` differing bits are linked, and ``component_id`` is the smallest ``doc_id``
    that a row can reach by links, itself included. Only distinct fingerprints are compared; copies join their
    fingerprint's group.

    Edge cases: a null or blank text has fingerprint 0, linked like any other; a null ``doc_id`` keeps its row and
    is never the smallest unless its whole group has none (then null); repeated rows are kept; an empty table gives
    no rows; other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    rows = stage(docs.select("doc_id", _fingerprints("text").alias("fp")), "fingerprints")
    by_fp = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = _roots(by_fp, distance)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = roots.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The documents less all but one of each near-duplicate group: the one of the smallest ``doc_id`` stays.

    All columns are kept, whatever their names. Rows that repeat that ``doc_id`` leave one row, and so does a group
    without any ``doc_id``.
    """
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stage(docs.select(whole, _fingerprints("text").alias("fp"), F.monotonically_increasing_id().alias("rid")), "rows")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "rid")
    by_fp = rows.groupBy("fp").agg(F.min(order).alias("first"))
    kept = _roots(by_fp, distance).groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    return rows.join(kept, "rid", "left_semi").select("row.*")


#: Wide fingerprints: so many words to a shingle, so many times 64 bits, in blocks of so many bits.
WIDE_SHINGLE, COPIES, WIDTH = 5, 6, 16


#: Documents whose shingles are counted, of about this many, to tell common shingles: those in so many of them.
SAMPLE, COMMON = 4000, 3


def _unique(text: str | None) -> np.ndarray:
    """The hashes of a text's wide shingles, once each, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    runs = zip(*(words[i:] for i in range(WIDE_SHINGLE))) if len(words) >= WIDE_SHINGLE else [words] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], np.uint64))


@F.pandas_udf(ArrayType(LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([_unique(t).view(np.int64) for t in texts])


def _needed(similarity: float, size: int) -> int:
    """Shingles that a set of this size shares at least with any set so similar."""
    return max(1, ceil(similarity * size - 1e-9))


#: Bits of a set's sketch at most. Sets of more than about twice as many shingles are hardly told apart by it.
SKETCH = 4096


def _sketch(one: np.ndarray) -> bytes:
    """A bit for each residue of the shingles' hashes, set if an odd number of them has it; about two bits a shingle or fewer.

    Two sketches of one width differ in no more bits than the sets have shingles apart, so they rule pairs out for
    certain. The halves of a sketch, one upon the other, are that of half the width.
    """
    width = min(SKETCH, max(64, 1 << (len(one) - 1).bit_length()))
    odd = np.bincount((one & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _wide_fingerprints(similarity: float, common: np.ndarray) -> Callable[[str], Column]:
    """A text's wide fingerprint ``fp``, its number of shingles ``n``, the digest, size, ``prefix`` and ``sketch`` of their set.

    All sets are laid out in one order, ``common`` shingles last; so many first ones are a set's prefix that two sets as
    similar as asked share at least one of them.
    """

    @F.pandas_udf(StructType([StructField("fp", BinaryType()), StructField("n", IntegerType()), StructField("digest", BinaryType()), StructField("size", IntegerType()), StructField("prefix", ArrayType(LongType())), StructField("sketch", BinaryType())]))
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            seen: list[np.ndarray] = []
            bits, n = _majorities(text, WIDE_SHINGLE, COPIES, seen)
            one = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint64)
            last = np.isin(one, common, assume_unique=True)
            order = np.concatenate([one[~last], one[last]])
            prefix = order[: len(one) - _needed(similarity, len(one)) + 1] if len(one) else order
            rows.append((np.packbits(bits, bitorder="little").tobytes(), n, xxhash.xxh3_128_digest(one.tobytes()), len(one), prefix.view(np.int64), _sketch(one)))
        return pd.DataFrame(rows, columns=["fp", "n", "digest", "size", "prefix", "sketch"])

    return made


def _common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of several of some thousand documents, ascending. They only order the sets, so no pair hangs on them."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.explode(_shingle_sets("text")).alias("s"))
    found = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def bits_within(similarity: float) -> int:
    """Differing bits of two wide fingerprints that count as so similar: the mean of such pairs and half a standard error.

    Shingle sets of Jaccard similarity s and equal size have the cosine 2s / (1 + s), and each bit differs with the
    probability of its angle over pi.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    return floor(64 * COPIES * p + 0.5 * sqrt(64 * COPIES * p * (1 - p)))


def _wide_forest(packed: list[bytes], distance: int) -> list[tuple[int, int]]:
    """:func:`_forest` of wide fingerprints, each followed by the eight bytes of its number."""
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    bits, ids = np.ascontiguousarray(rows[:, :-8]).view(np.uint64), np.ascontiguousarray(rows[:, -8:]).view(">i8").ravel().astype(np.int64)
    near = np.empty((len(ids), len(ids)), bool)
    for at in range(0, len(ids), 256):
        near[at : at + 256] = np.bitwise_count(bits[at : at + 256, None] ^ bits[None]).sum(2, dtype=np.int64) <= distance
    np.fill_diagonal(near, False)
    return stars(near, ids)


def similar_edges(fps: DataFrame, distance: int, chunk: int = 1024) -> DataFrame:
    """Edges ``(src, dst)`` between numbers of wide fingerprints (``id, fp, n``) within ``distance`` bits that share a block.

    A key is a block's bits, its place and the size class of ``n``. Classes double; those of odd blocks lie half a
    class higher, so texts of about one length share the class of half their blocks at least.
    """
    keys = []
    for i in range(64 * COPIES // WIDTH):
        size_class = F.floor(F.log2(F.col("n") + 1) + 0.5 * (i % 2)).cast("long")
        bits = F.conv(F.hex(F.substring("fp", 1 + i * WIDTH // 8, WIDTH // 8)), 16, 10).cast("long")
        keys.append((F.lit(i * 64) + size_class) * (1 << WIDTH) + bits)
    number = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    keyed = fps.select(F.concat("fp", number).alias("fp"), F.explode(F.array(*keys)).alias("key"))
    return _compared(keyed, lambda packed: _wide_forest(packed, distance), chunk, False)


def _partners(keyed: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``keyed`` (``key, rid, at``) that another of their key may be as similar to.

    ``at`` is twice the set's size, and one more where the key lies behind the first ``1 - 2s / (1 + s)`` of the set. The
    first shingle that two such sets share lies before that in the smaller one, so a row stays if it is before that and
    a set as large or larger is in reach, or if such a smaller one is. Equal keys meet by sorting, sizes ascending: a task
    holds a batch at a time.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told, early = np.empty((3, 0), np.int64), False, 0  # the row before this batch, if it is out already, and the largest early size of its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rid, at = rows = np.concatenate([last, [batch.column(c).to_numpy() for c in ("key", "rid", "at")]], 1)
            size, first = at >> 1, (at & 1) == 0
            same = np.r_[False, key[1:] == key[:-1]]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            before = np.r_[-1, np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))[:-1]]
            least = np.where(before >= start, size[before], np.where(start == 0, early, 0))
            after = np.r_[same[1:] & (size[:-1] >= similarity * size[1:] - 1e-9), False] & first
            out = after | (least >= similarity * size - 1e-9)
            if last.shape[1]:
                out[0] = after[0] and not told
            early = int(size[-1]) if first[-1] else int(least[-1])
            last, told = rows[:, -1:], bool(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, rid)], names=["key", "rid"])

    return keyed.repartition("key").sortWithinPartitions("key", "at").mapInArrow(near, "key long, rid long")


def _close_pairs(packed: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Pairs of numbers of different roots whose sizes and sketches leave it open that they are as similar.

    ``packed`` sets are their number, root and size, eight bytes each, and their sketch.
    """
    rid, root, size = np.frombuffer(b"".join(p[:24] for p in packed), ">i8").reshape(-1, 3).astype(np.int64).T
    if (root == root[0]).all():
        return []
    width, pairs = np.array([len(p) for p in packed]) - 24, []
    bits = lambda at, w: np.frombuffer(b"".join(packed[i][24:] for i in at), np.uint64).reshape(len(at), w // 8)
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)  # sizes so similar are no farther apart
        left, folded = bits(own, w), bits(wider, 2 * w)
        right = np.concatenate([left, folded[:, : w // 8] ^ folded[:, w // 8 :]])
        other = np.concatenate([own, wider])
        step = max(1, (1 << 20) // right.size)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            a, b = size[part, None], size[None, other]
            apart = np.bitwise_count(left[at : at + step, None] ^ right[None]).sum(2, dtype=np.int64)
            near = apart <= (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6
            near &= (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (root[part, None] != root[None, other])
            near[:, : len(own)] &= rid[part, None] < rid[None, own]
            x, y = np.nonzero(near)
            pairs += zip(rid[part][x].tolist(), rid[other][y].tolist())
    return pairs


def _shared_prefixes(rows: DataFrame, sets: DataFrame, similarity: float, chunk: int = 1024) -> DataFrame:
    """``src, dst`` of sets (``rid, root, size, sketch``) of different roots that may be as similar: all that are, and few others.

    Such sets share a shingle of their prefixes (``rid, prefix`` of ``rows``). Only shingles that several sets of different
    roots share lead to sets; what meets there is compared by sizes and sketches, and no other pair comes out of a task.
    """
    early = F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9)
    keys = rows.select("rid", "prefix").join(sets.select("rid", "size"), "rid").select("rid", "size", F.posexplode("prefix").alias("place", "key"))
    keyed = keys.select("key", "rid", (F.col("size").cast("long") * 2 + (F.col("place") > early).cast("long")).alias("at"))
    shared = stage(_partners(keyed, similarity).join(sets.select("rid", "root"), "rid"), "shared")
    mixed = shared.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / chunk).alias("parts")).where("low < high")
    members = shared.join(mixed.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    dealt = members.select("key", "rid", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    packed = sets.select("rid", F.concat(number("rid"), number("root"), number(F.col("size").cast("long")), "sketch").alias("fp"))
    unit = [F.col("key"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")]
    met = dealt.join(packed, "rid").select(*unit, "fp").repartition("key", "a", "b")
    groups = met.groupBy("key", "a", "b").agg(F.collect_list("fp").alias("fps")).select("fps")
    return _edges(groups, lambda fps: _close_pairs(fps, similarity))


def exact_edges(rows: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: pairs of roots between rows as similar or more by their sets of shingles, all that ``roots`` leaves apart.

    ``rows`` has ``row.text, fp, digest, size, prefix, sketch, rid``, ``roots`` each fingerprint's ``fp, root``. One row
    stands for all of one set; sets of one fingerprint are compared by themselves.
    """
    of = rows.select("digest", "fp", "rid", "size", "sketch").where("size > 0").join(roots.select("fp", "root"), "fp")
    sets = stage(of.groupBy("digest").agg(F.min(F.struct("rid", "root", "size", "sketch")).alias("s"), F.max("root").alias("high"), F.min("root").alias("low"), F.collect_set("root").alias("all")), "sets")
    equal = sets.where("high > low").select(F.explode("all").alias("src"), F.col("low").alias("dst")).where("src <> dst")
    sets = sets.select("s.*")
    pairs = stage(_shared_prefixes(rows, sets, similarity).toDF("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    texts = rows.select("rid", F.col("row.text").alias("text")).join(ids, "rid", "left_semi")
    whole = stage(texts.select("rid", _shingle_sets("text").alias("set")).join(sets.select("rid", "root"), "rid"), "whole")
    a, b = (whole.select(F.col("rid").alias(c), F.col("set").alias(f"s{c}"), F.col("root").alias(r)) for c, r in (("a", "src"), ("b", "dst")))
    both = F.size(F.array_intersect("sa", "sb"))
    close = both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9
    return pairs.join(a, "a").join(b, "b").where(close).select("src", "dst").unionAll(equal)


def _similar(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints (``row, fp, rid``), and ``fp, first, root`` of each distinct fingerprint."""
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = _wide_fingerprints(similarity, _common_shingles(docs))
    rows = stage(docs.select(whole, wide("text").alias("w"), F.monotonically_increasing_id().alias("rid")).select("row", "w.*", "rid"), "rows")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "rid")
    by_fp = rows.groupBy("fp").agg(F.min(order).alias("first"), F.min("n").alias("n"))
    by_fp = stage(by_fp.withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    linked = connected_components(similar_edges(by_fp.select("id", "fp", "n"), bits_within(similarity)))
    roots = stage(by_fp.join(linked, by_fp["id"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "id").alias("root")), "roots")
    more = connected_components(exact_edges(rows, roots, similarity)).withColumnRenamed("root", "further")
    roots = roots.join(more, F.col("root") == F.col("node"), "left").select("fp", "first", F.coalesce("further", "root").alias("root"))
    return rows.select("row", "fp", "rid"), roots


def similar_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: near-duplicates by five-word shingles of about ``similarity`` or more.

    Fingerprints of 384 bits lie in 24 blocks of 16; those that share a block and differ in few enough bits for the
    similarity (:func:`bits_within`) are linked. Pairs that this leaves out are found by their shingles themselves
    (:func:`exact_edges`), so all pairs whose sets of shingles have that Jaccard similarity are linked, and some that
    are a little less alike. ``component_id`` is the smallest ``doc_id`` reachable.

    Edge cases: texts of fewer than five words have one shingle, the whole; null and blank texts are all alike; a
    null ``doc_id`` keeps its row and is never the smallest unless its whole group has none (then null); repeated
    rows are kept; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    rows, roots = _similar(docs, similarity)
    least = roots.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("component_id"))
    groups = roots.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select("row.doc_id", "component_id")


def keep_first_similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents less all but one of each group of :func:`similar_groups`: the one of the smallest ``doc_id`` stays.

    All columns are kept, whatever their names. Rows that repeat that ``doc_id`` leave one row, and so does a group
    without any ``doc_id``.
    """
    rows, roots = _similar(docs, similarity)
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    dropped = stage(rows.select("rid").join(kept, "rid", "left_anti"), "dropped")  # few and small, so that texts seldom move
    return rows.join(dropped, "rid", "left_anti").select("row.*")


def _roots(by_fp: DataFrame, distance: int) -> DataFrame:
    """``by_fp`` with the fingerprint that stands for the group of each as ``root``."""
    linked = connected_components(near_edges(by_fp.select("fp"), distance)).withColumnRenamed("node", "fp")
    return by_fp.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
