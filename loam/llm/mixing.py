"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import WORD, running, stage

#: No document, and so no source, is taken more often than this.
REPEATS = 3


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[int]) -> DataFrame:
    """``sources`` (``source, source_size``) with the column ``target``, the words the mix wants of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops
    at ``REPEATS`` times its source's size, and the rest goes to the others by weight, until none is above. That is
    the one level ``x`` at which ``min(limit, x * weight)`` sums to the total: in order of ``limit / weight`` the
    first sources meet their limits and all others share what is left. Ranks and sums run over ranges of sources, so
    there may be any number of them.
    """
    by_name = F.col("source").asc_nulls_last()
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1
    weighed = running(sources, [], [by_name], {"place": F.lit(1)})
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double"))
    weighed = weighed.withColumn("most", F.col("source_size") * REPEATS).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = running(weighed, [], [F.col("ratio"), by_name], {"most_upto": F.col("most"), "weight_upto": F.col("weight")})
    total, weight = sources.agg(F.sum("source_size")).first()[0] or 0, weighed.agg(F.sum("weight")).first()[0] or 0.0
    left = F.lit(total) - (F.col("most_upto") - F.col("most"))
    level = left / (F.lit(weight) - (F.col("weight_upto") - F.col("weight")))
    stepped = filled.withColumn("level", level).where(F.col("most") > F.col("level") * F.col("weight"))
    first = stepped.agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    share = F.col("weight") * F.lit(float("inf") if first is None else first)
    return weighed.select("source", "source_size", F.least(F.col("most").cast("double"), share).alias("target"))


def _joined(rows: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the columns of ``stats``, one row a group; null is a group like any other."""
    renamed = stats.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[c for c in stats.columns if c not in group])
    if not group:
        values = stats.first().asDict()
        return rows.withColumns({k: F.lit(v).cast(stats.schema[k].dataType) for k, v in values.items()})
    return rows.join(renamed, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]).drop(*[f"_g_{g}" for g in group])


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """``parties`` with ``quota``: within each group its ``seats`` by highest Sainte-Lague quotients votes / (2k + 1).

    With p parties, all seats up to ``votes * (seats - p) / total + 1/2`` are certain and none beyond
    ``votes * (seats + p) / total + 1/2`` can be won, so that about three quotients a party need ranking; they are
    ranked by ranges, so a group may have any number of parties. Ties go to the smaller ``party``, null last. No quota
    exceeds the column ``most``. ``parties`` is read several times, so pass a staged table.
    """
    names = parties.columns
    known = _joined(parties, parties.groupBy(*group).agg(F.sum(votes).alias("_total"), F.count("*").alias("_p")), group)
    bound = lambda n: F.greatest(F.lit(0.0), F.floor(F.col(votes) * n / F.col("_total") + 0.5)).cast("long")
    some = F.col("_total") > 0
    sure = F.when(some & (F.col(seats) > F.col("_p")), bound(F.greatest(F.col(seats) - F.col("_p"), F.lit(0)))).otherwise(0)
    known = known.withColumn("_sure", sure).withColumn("_last", F.when(some, bound(F.col(seats) + F.col("_p"))).otherwise(0))
    known = stage(_joined(known, known.groupBy(*group).agg(F.sum("_sure").alias("_taken")), group), "parties")
    tried = known.withColumn("_k", F.explode(F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_last") - 1))))
    tried = tried.select(*dict.fromkeys([*group, party]), (F.col(seats) - F.col("_taken")).alias("_rest"), "_k", (F.col(votes) / (2 * F.col("_k") + 1)).alias("_quotient"))
    ranked = running(tried, group, [F.col("_quotient").desc(), F.col(party).asc_nulls_last(), F.col("_k")], {"_place": F.lit(1)})
    own = list(dict.fromkeys([*group, party]))
    won = ranked.where(F.col("_place") <= F.col("_rest")).groupBy(*own).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in own], "_won")
    counted = known.join(won, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in own], "left")
    return counted.select(*names, F.least(F.col("_sure") + F.coalesce("_won", F.lit(0)), F.col(most)).alias("quota"))


def mix(
    docs: DataFrame, keys: list[str], weights: list[int] = (1, 2, 3), block: int = 16, shard_words: int = 500_000, seed: int = 5, by: list[str] | None = None
) -> DataFrame:
    """Rows of ``keys`` and ``size, source_size, target, taken``: how many words of each document the mix takes.

    ``docs`` has ``keys`` (the first identifies a document), ``source`` and ``size`` (words) and is read several
    times, so pass a staged table. All sizes together make as many blocks of ``block`` words. Highest quotients deal
    them to the sources by target, then a source's blocks to its shards of about ``shard_words`` words by size. A
    shard's documents stand in seeded order as a ring; a seeded start and the shard's quota select a run of blocks
    around it, at most ``REPEATS`` times, and ``taken`` is what the run covers of a document. Everything depends on
    the rows alone, so reruns agree; a window never holds more than one shard, whatever a source's share. ``by`` names
    the columns whose hash deals and orders documents, where that is not ``keys``.
    """
    by = by or keys
    docs = docs.select(*dict.fromkeys([*keys, *by]), "source", "size")
    sums = stage(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    all_blocks = (sums.agg(F.sum("source_size")).first()[0] or 0) // block
    plan = stage(targets(sums, list(weights)), "targets")
    plan = plan.withColumn("seats", F.lit(all_blocks).cast("long")).withColumn("most", F.floor(F.col("source_size") * REPEATS / block))
    plan = apportion(plan, [], "source", "target", "seats", "most").withColumnRenamed("quota", "source_quota")
    plan = plan.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words)))
    plan = stage(plan.select("source", "source_size", "target", "source_quota", "shards"), "sources")
    key = F.xxhash64(F.lit(seed), *by)
    placed = docs.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), *by), F.col("shards")))
    placed = placed.withColumn("order", key)
    shards = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_quota").alias("seats"), F.count("*").alias("n")
    )
    shards = stage(shards.withColumn("most", F.floor(F.col("shard_size") * REPEATS / block)), "shards")
    shards = apportion(shards, ["source"], "shard", "shard_size", "seats", "most")
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") * block / F.col("shard_size"))).otherwise(0)
    shards = shards.withColumn("rounds", whole).withColumn("run", F.col("quota") * block - F.col("rounds") * F.col("shard_size"))
    begin = F.when(F.col("shard_size") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("shard_size"))).otherwise(0)
    shards = shards.withColumn("begin", begin).withColumnsRenamed({"source": "s2", "shard": "h2"})
    ring = Window.partitionBy("source", "shard").orderBy("order", *by, *keys, "size")
    # Documents without words take nothing and stay out of the rings, which hold no more rows than a shard has words.
    laid = placed.where("size > 0").withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(shards.select("s2", "h2", "rounds", "run", "begin", "shard_size"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")))
    low, high = F.col("end") - F.col("size"), F.col("end")
    cover = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(high, b) - F.greatest(low, a))
    stop = F.col("begin") + F.col("run")
    taken = F.col("rounds") * F.col("size") + cover(F.col("begin"), stop) + cover(F.lit(0).cast("long"), stop - F.col("shard_size"))
    blank = placed.where("size = 0").select(*keys, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return laid.select(*keys, "size", "source_size", "target", taken.cast("long").alias("taken")).unionAll(blank)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row, staged: the texts are read once."""
    return stage(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document of the mix (see :func:`mix`).

    Edge cases: a null text has no words; null sources are one source, the last; a null ``doc_id`` is a document like
    any other; repeated rows are separate documents; sources without words get the target 0; an empty table gives no
    rows; other columns are ignored.
    """
    return mix(sized(docs), ["doc_id"])


def take_whole(docs: DataFrame) -> DataFrame:
    """The mix as documents, all their columns kept: each as often as its taken words fill it, to the nearest copy.

    A shard's run ends inside at most two documents, so rounding moves few words. Rows are dealt and ordered by their
    id, source and text, so equal documents give an equal mix however they are laid out.

    Edge cases: a null or blank text has no words and is not in the mix; null sources are one source, the last; null
    and repeated ``doc_id`` are rows like any other; an empty table gives no rows; columns of any name are kept.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stage(docs.select(whole, F.monotonically_increasing_id().alias("rid"), word_count("text").alias("size")), "rows")
    own = F.xxhash64("row.doc_id", "row.source", "row.text").alias("own")
    plan = mix(rows.select("rid", own, F.col("row.source").alias("source"), "size"), ["rid"], by=["own"])
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    plan = plan.where("taken > 0").select("rid", copies.alias("copies")).where("copies > 0")
    return rows.join(plan, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
