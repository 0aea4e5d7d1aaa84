"""Which of many names stand in which of many texts: one automaton of all names, run once over every text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names are sent to tasks in lots of at most about this many characters; each lot is one more pass over the texts.
LOT = 4 << 20


def _finder(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, name in enumerate(names):
        found.add_word(name, k)
    found.make_automaton()
    return found


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, lot: int = LOT) -> DataFrame:
    """``name, key`` of every name that a text holds anywhere, once for each row of ``texts``; case counts.

    Names are dealt by hash into lots whose size is checked, so that no task is sent more than about ``lot`` characters,
    and each lot's automaton reads every text once, in time that grows with the text alone. Null and empty names and texts
    meet nothing.
    """
    spark = texts.sparkSession
    known = names.where(F.col(name) != "").select(F.col(name).alias("name")).distinct()
    size = known.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    lots = -(-int(size) // lot)
    kind = texts.schema[key].dataType.simpleString()
    body = texts.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = spark.createDataFrame([], f"name string, key {kind}")
    for part in range(lots):
        held = [r["name"] for r in known.where(F.pmod(F.xxhash64("name"), F.lit(lots)) == part).toLocalIterator()]

        def find(batches: Iterator[pa.RecordBatch], held: list[str] = held) -> Iterator[pa.RecordBatch]:
            automaton = _finder(held)
            for batch in batches:
                rows, hits = [], []
                for row, told in enumerate(batch.column("text").to_pylist()):
                    for k in {k for _, k in automaton.iter(told)}:
                        rows.append(row)
                        hits.append(held[k])
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), batch.column("key").take(pa.array(rows, pa.int64()))], names=["name", "key"])

        if held:
            out = out.unionAll(body.mapInArrow(find, f"name string, key {kind}"))
    return out
