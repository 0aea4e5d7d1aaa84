"""Joins of spans that overlap, as equi joins on bins of doubling length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.lineage import settle


def _level(low: Column, high: Column) -> Column:
    """The least n for which a bin of 2^n is as long as the span."""
    return F.when(low == high, 0).otherwise(F.length(F.bin(high - low)))


def overlapping(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """All pairs of rows with equal ``on`` whose spans (both ends included) have a place in common, each pair once.

    A span lies in the one or two bins of its own level, whose bins are the first ones not shorter than it, and in those
    of the coarser levels that the other side's spans have. A pair meets where the longer one has its own level, so long
    spans are never cut into many bins, and spans far apart never meet. No key holds more pairs than a constant times
    those that overlap or nearly do, however many spans one ``on`` has. Both sides are computed once. Spark takes them to
    be as small before they are laid into bins as after, so the joins are told to shuffle: else it may broadcast them.

    Columns are those of ``left`` and then those of ``right`` without ``on``; names must differ. Rows with a null ``on``
    or end meet nothing; ends in the wrong order stand for the span between them, but must still overlap as they are.
    """
    whole = lambda c: F.col(c).cast("long")
    sides = []
    for name, df, (start, end) in (("l", left, left_span), ("r", right, right_span)):
        low, high = F.least(whole(start), whole(end)), F.greatest(whole(start), whole(end))
        known = df.where(F.col(on).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
        carried = [F.col(c).alias(f"_{name}_{c}") for c in df.columns]
        sides.append(settle(known.select(F.col(on).alias("_on"), *carried, low.alias(f"_{name}low"), high.alias(f"_{name}high"), _level(low, high).cast("int").alias("_own"))))
    has = [[F.lit(r[0]) for r in df.select("_own").distinct().collect()] for df in sides]  # lengths in bits, 65 at most

    def binned(df: DataFrame, name: str, levels: Column) -> DataFrame:
        """A row for each bin of the span in these levels."""
        laid = df.withColumn("_level", F.explode(levels))
        at = lambda c: F.call_function("shiftright", F.col(f"_{name}{c}"), F.col("_level"))
        held = [c for c in df.columns if c.startswith(f"_{name}_")]
        return laid.select("_on", *held, at("low").alias(f"_{name}bin"), "_level", F.explode(F.sequence(at("low"), at("high"))).alias("_bin"))

    own, none = F.array("_own"), F.array().cast("array<int>")
    up = F.filter(F.array(*has[1]), lambda x: x >= F.col("_own")) if has[1] else none
    over = F.filter(F.array(*has[0]), lambda x: x > F.col("_own")) if has[0] else none
    met = [
        binned(sides[0], "l", up).join(binned(sides[1], "r", own).hint("shuffle_merge"), ["_on", "_level", "_bin"]),
        binned(sides[0], "l", own).join(binned(sides[1], "r", over).hint("shuffle_merge"), ["_on", "_level", "_bin"]),
    ]
    (a, b), (c, d) = left_span, right_span
    once = F.col("_bin") == F.greatest("_lbin", "_rbin")  # of the bins in which two spans meet, the first
    touch = (F.col(f"_l_{a}") <= F.col(f"_r_{d}")) & (F.col(f"_r_{c}") <= F.col(f"_l_{b}"))
    named = [F.col(f"_l_{x}").alias(x) for x in left.columns] + [F.col(f"_r_{x}").alias(x) for x in right.columns if x != on]
    return met[0].unionByName(met[1]).where(once & touch).select(*named)
