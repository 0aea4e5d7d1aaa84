"""Retrieval snippets: a file's symbols, or else pieces of 120 lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

CHUNK_LINES = 120


def chunk_lines(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Snippets of ``size`` lines; an empty file has none."""
    cut = files.where("text <> ''").select("path", "lang", "pos", T.split_lines("text").alias("lines"))
    end = lambda at: F.least(at + size, F.size("lines"))
    piece = lambda at: F.struct(at.alias("at"), end(at).alias("end"), F.array_join(F.slice("lines", at + 1, F.lit(size)), "\n").alias("text"))
    cut = cut.select("path", "lang", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size)), piece)).alias("p"))
    return cut.select(
        "p.text", T.cite("path", F.col("p.at") + 1, "p.end").alias("cite"), F.lit(0.0).alias("score"), "path", "lang",
        F.lit("").alias("symbol"), F.lit("chunk").alias("kind"), (F.col("pos").cast("long") * 1_000_000 + F.col("p.at")).alias("pos"),
    )


def chunk_symbols(files: DataFrame, symbols: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """A snippet for each symbol, by start line, overlaps included; files without symbols fall to :func:`chunk_lines`."""
    listed = F.collect_list(F.struct("name", "kind", "start_line", "end_line")).alias("symbols")  # of one file, which has a largest size
    held = files.select("path", "lang", "pos", T.split_lines("text").alias("lines")).join(symbols.groupBy("path").agg(listed), "path")

    def piece(s: Column) -> Column:
        body = T.line_slice(F.col("lines"), F.greatest(F.lit(1), s["start_line"]), s["end_line"])
        return F.struct(body.alias("text"), s["name"].alias("symbol"), s["kind"].alias("kind"), s["start_line"].alias("start"), s["end_line"].alias("end"))

    cut = held.select("path", "lang", "pos", F.explode(F.transform("symbols", piece)).alias("s"))  # a file's lines are split and sliced in its one row
    own = cut.select(
        "s.text", T.cite("path", "s.start", "s.end").alias("cite"), F.lit(0.0).alias("score"), "path", "lang", "s.symbol", "s.kind",
        (F.col("pos").cast("long") * 1_000_000 + F.col("s.start")).alias("pos"),
    )
    rest = files.join(symbols.select("path").distinct(), "path", "left_anti")
    return own.unionByName(chunk_lines(rest, size))
