"""How far the sources of a language lie apart: exact term divergences by a three-dimensional cube of tasks.

For every language, groups (its sources) are dealt into blocks by hash, and so are the terms it keeps. A cell of the
cube is a pair of group blocks and a term block: it gets the slices of both group blocks in that term block, and gives
the part of each pair's divergence that those terms make. Sums along the term axis are the divergences. Slices are
sparse: a term that a group lacks has the group's floor probability, which the group's header row carries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import join_groups, small_batches, stage

#: ASCII letters in lower case and all of UTF-8's other bytes stay; the rest separates terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: So many bytes of a text are split at once, and so many distinct terms does a task hold before it passes them on.
PIECE, HELD = 1 << 20, 200_000
SCALE = 1_000_000_000


def pieces(text: str, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists that come from about ``size`` bytes each."""
    raw = text.encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = len(raw) if at + size >= len(raw) else raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, source, term, n, docs``: a term's occurrences in a group, and the documents that hold it.

    Nulls are empty strings. Tasks add up what they read before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in sums.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                    columns += [terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            sums.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, docs = sums.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in pieces(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(n) for n, _ in sums.values()) > held:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))``, exact for any counts of 64 bits."""
    whole = lambda c: c.cast("decimal(19,0)")
    above = whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, whole(total + kept)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def cell(rows: pa.Table) -> pa.Table:
    """One cell's part of the divergences between the groups of its two blocks, in both directions.

    ``rows`` holds a header (null term, floor probability, number of terms in the block) for each group, and a row for
    each term that the group has. No product or sum leaves 64 bits: probabilities are at most 1e9 + 1, and over all
    terms their sum is at most 1e9 and a count of terms.
    """
    term, p = rows.column("term").combine_chunks(), rows.column("p").to_numpy()
    head = term.is_null().to_numpy(zero_copy_only=False)
    sources = rows.column("source").combine_chunks().dictionary_encode()
    names, who = sources.dictionary, sources.indices.to_numpy()
    block = np.zeros(len(names), np.int64)
    floor = np.zeros(len(names), np.int64)
    block[who[head]], floor[who[head]] = rows.column("block").to_numpy()[head], p[head]
    terms = term.filter(pa.array(~head)).dictionary_encode()
    dense = np.repeat(floor[:, None], len(terms.dictionary), 1)
    dense[who[~head], terms.indices.to_numpy()] = p[~head]
    rest = rows.column("kept").to_numpy()[head][0] - dense.shape[1]  # terms of the block that no group here has
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    ones, others, values = [], [], []
    for s in left:
        two = right if i != j else right[right > s]
        square, base = (dense[s] - dense[two]) ** 2, (floor[s] - floor[two]) ** 2
        for a, b, q, q0 in ((np.full(len(two), s), two, dense[two], floor[two]), (two, np.full(len(two), s), dense[s], floor[s])):
            ones.append(a)
            others.append(b)
            values.append((square // q).sum(1) + rest * (base // q0))
    ones, others, values = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ones, others, values))
    lang = pa.array([rows.column("lang")[0].as_py()] * len(ones), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(ones)), "item": names.take(pa.array(others)), "value": pa.array(values, pa.int64())})


def source_divergence(
    docs: DataFrame, least: int = 3, top: int = 200, group_block: int = 64, term_block: int = 4096, held: int = HELD, slices: int = 8
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (``lang, source``) of ``docs`` (``text, lang, source``).

    A language keeps the terms that at least ``least`` of its documents hold. Part ``pair`` has a row for each other
    source of the language, its divergence summed over all kept terms; part ``term`` the ``top`` kept terms that the
    group has more often than its language, by their own divergence. Ranks go from the largest value on, ties by item.

    A cell holds about two blocks of ``group_block`` groups and ``term_block`` terms, whatever the size of the corpus;
    a group with a third of all words is cut along the term axis like any other. ``slices`` pieces of a group's terms
    are ranked first, and their best ones together then.

    Edge cases: null text, language and source are empty strings, which are values like any other; groups without terms
    have all their pairs (value 0 where the language keeps no term) and no term rows; repeated rows count each; a
    language of one source has no pairs; an empty table gives no rows; other columns are ignored.
    """
    counts = stage(term_counts(docs, held), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stage(kept.select("lang", "term", "all"), "kept")
    known = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "known")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    many = named.groupBy("lang").agg(F.count("*").alias("groups"))
    zero = lambda *names: [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names]
    groups = named.join(totals, ["lang", "source"], "left").join(many, "lang").join(langs, "lang", "left")
    groups = groups.select("lang", "source", "groups", *zero("total", "rows", "kept", "lang_total"))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    groups = groups.withColumns({"blocks": parts("groups", group_block), "slabs": parts("kept", term_block)})
    groups = stage(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "groups")
    slab = F.pmod(F.xxhash64("term"), "slabs").cast("int")
    rows = join_groups(known, groups.where("rows > 0"), ["lang", "source"], "rows")
    rows = stage(rows.withColumns({"p": probability(F.col("n"), F.col("total"), F.col("kept")), "slab": slab}), "slices")

    # Part term: first the best of each slice of a group, then the best of those.
    q = probability(F.col("all"), F.col("lang_total"), F.col("kept"))
    above = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    above = above.withColumn("slice", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(slices)))
    for by in (["lang", "source", "slice"], ["lang", "source"]):
        above = above.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    best = above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # Part pair: the cells of the cube, then sums along the term axis.
    inside = join_groups(kept, langs.select("lang", "kept", parts("kept", term_block).alias("slabs")), ["lang"], "kept")
    sizes = inside.groupBy("lang", slab.alias("slab")).agg(F.count("*").alias("in_slab"))
    heads = groups.where("groups > 1").withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    heads = heads.join(sizes, ["lang", "slab"], "left").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.when(F.col("kept") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(1)).alias("p"),
        "block", "blocks", "slab", *[F.coalesce("in_slab", F.lit(0)).cast("long").alias("kept")],
    )
    data = rows.where("groups > 1").select("lang", "source", "term", "p", "block", "blocks", "slab", F.lit(0).cast("long").alias("kept"))
    copies = heads.unionAll(data).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = copies.select("lang", "source", "term", "p", "block", "kept", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slab")
    partial = cells.groupBy("lang", "i", "j", "slab").applyInArrow(cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionAll(best)
