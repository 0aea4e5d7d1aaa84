"""Bounded training samples and hashed character n-grams, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A worker's cache of word scores is emptied beyond this many words.
CACHE_WORDS = 500_000


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int, least: int = 0) -> pd.DataFrame:
    """``text, label`` of at most ``rows`` labelled documents of at most ``chars`` characters each, on the driver.

    The rows are those of the smallest hash of ``doc_id`` among the labelled ones where ``learn`` holds and whose text
    can be learned from, so the same tables always give the same sample and no other label takes up a place. A document with several labels counts by their mean. These two bounds hold
    for learning alone; scoring reads every whole text. Fewer than ``least`` rows for a table with rows are an error.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    votes = votes.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text")
    chosen = votes.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` small rows
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "label").toPandas()
    if len(got) < least and not docs.isEmpty():
        raise ValueError(f"{len(got)} labelled documents to learn {label!r} from, fewer than {least}")
    return got


#: Words whose n-grams are hashed at a time: what lies beside the result stays small.
AT_ONCE = 1 << 14


def ngrams(words: list[str], shortest: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of the words, their ends marked, and how many each word has.

    The buckets lie word after word. Every word has at least one n-gram: one shorter than ``shortest`` with its marks
    counts as a whole.
    """
    parts = [_ngrams(words[i : i + AT_ONCE], shortest, longest, bits) for i in range(0, len(words), AT_ONCE)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ngrams(words: list[str], shortest: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    pad = "\0" * max(0, shortest - 2)
    marked = [f"<{w}>" if len(w) + 2 >= shortest else f"<{w}>{pad}" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    word, rows, found = np.repeat(np.arange(len(words)), sizes), [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        value = value[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n >= shortest:
            at = np.flatnonzero(left[: len(value)] >= n)
            mixed = value[at] ^ (value[at] >> np.uint64(29))
            found.append((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32))
            rows.append(word[at])
    rows, found = np.concatenate(rows), np.concatenate(found)
    return found[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(words))


class Vocabulary:
    """Word types of a sample with their buckets, word after word in ``flat``, and how many each has."""

    def __init__(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = {w: i for i, w in enumerate(words)}
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of these word ids in turn, and for each bucket the place of its word in ``words``."""
        sizes = self.sizes[words]
        at = np.repeat(self.starts[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.flat[at], np.repeat(np.arange(len(words)), sizes)
