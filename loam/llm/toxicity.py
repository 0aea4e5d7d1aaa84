"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, fsum, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loam.llm.common import small_batches, worker_cache
from loam.llm.training import AT_ONCE, CACHE_WORDS, Vocabulary, labelled_sample, ngrams, remainder

SHORTEST, LONGEST, BITS = 3, 6, 18
#: Between a plain sum, where long texts drift, and a mean, where a few words drown in them.
DAMP = 0.5


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class NgramModel:
    """``sigmoid(bias + sum of n-gram weights / d ** DAMP)`` over a document's ``d`` distinct words, case folded.

    The weights already hold the log-count ratios.
    """

    weights: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, texts: list[str | None]) -> list[float]:
        """One for each text, whatever the order of its words; an empty text gets the bias alone."""
        cache = worker_cache(self.name, dict)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        docs = [_words(t) for t in texts]
        new = list(set().union(*docs).difference(cache))
        buckets, sizes = ngrams(new, SHORTEST, LONGEST, BITS)
        if new:
            cache.update(zip(new, np.add.reduceat(self.weights[buckets], np.cumsum(sizes) - sizes).tolist()))
        return [fsum(map(cache.__getitem__, d)) / max(1, len(d)) ** DAMP + self.bias for d in docs]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.array([1 / (1 + exp(-x)) if x >= 0 else exp(x) / (1 + exp(x)) for x in self.margins(texts)])


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap between margins among those cuts that make the fewest errors."""
    order = np.argsort(margins, kind="stable")
    z, y = margins[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(2 * y - 1)]) + (1 - y).sum()  # a cut before place i rejects the rest
    gaps = np.where(errors[1:-1] == errors.min(), np.diff(z), -1.0)
    return float((z[gaps.argmax()] + z[gaps.argmax() + 1]) / 2) if gaps.max() > 0 else 0.0


def train(texts: list[str], labels: np.ndarray) -> NgramModel:
    """Fit on four fifths of the sample, then move the bias so that a score of 0.5 cuts best on the other fifth."""
    labels = np.asarray(labels, float)
    fifth = np.arange(len(labels)) % 5 == 4
    model = fit([t for t, x in zip(texts, fifth) if not x], labels[~fifth])
    if 0 < labels[fifth].sum() < fifth.sum() and model.weights.any():
        model.bias -= best_cut(np.array(model.margins([t for t, x in zip(texts, fifth) if x])), labels[fifth])
    return model


def fit(texts: list[str], labels: np.ndarray, alpha: float = 1.0, l2: float = 1e-6, updates: int = 800, batch: int = 32, rate: float = 0.5) -> NgramModel:
    """Log-count ratios of the n-grams, then logistic regression on the scaled features by numpy Adagrad.

    Without both classes the model gives every text the smoothed share of the positive class.
    """
    labels, model = np.asarray(labels, float), NgramModel(np.zeros(1 << BITS), 0.0)
    positive, n, buckets = labels.sum(), len(labels), 1 << BITS
    model.bias = float(np.log((positive + 0.5) / (n - positive + 1.5)))
    if not 0 < positive < n:
        return model
    docs = [sorted(_words(t)) for t in texts]
    known = sorted(set().union(*docs))
    words = Vocabulary(known, *ngrams(known, SHORTEST, LONGEST, BITS))
    docs = [np.array([words.ids[w] for w in d], np.int64) for d in docs]
    counts = np.full((2, buckets), alpha)
    for y in (0, 1):
        every = np.concatenate([d for d, t in zip(docs, labels) if t == y])
        held = np.bincount(every, minlength=len(words.ids)).astype(float)
        for some in np.array_split(np.flatnonzero(held), 1 + len(held) // AT_ONCE):
            flat, place = words.of(some)
            counts[y] += np.bincount(flat, held[some][place], buckets)
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = np.where(labels == 1, n / 2 / positive, n / 2 / (n - positive))  # both classes weigh the same
    w, b, seen, seen_b, rng = np.zeros(buckets), model.bias, np.full(buckets, 1e-6), 1e-6, np.random.default_rng(8)
    for _ in range(max(5, updates * batch // n)):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            some = order[at : at + batch]
            size = np.array([max(1, len(docs[i])) for i in some])
            types, back = np.unique(np.concatenate([docs[i] for i in some]), return_inverse=True)
            doc = np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
            flat, place = words.of(types)
            value = np.bincount(place, (w * ratio)[flat], len(types))
            z = np.bincount(doc, value[back], len(some)) / size**DAMP + b
            wrong = share[some] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / len(some)
            g = np.bincount(flat, np.bincount(back, (wrong / size**DAMP)[doc], len(types))[place], buckets) * ratio
            hit = np.flatnonzero(g)
            g = g[hit] + l2 * w[hit]
            seen[hit] += g * g
            w[hit] -= rate * 0.1 * g / np.sqrt(seen[hit])
            seen_b += wrong.sum() ** 2
            b -= rate * wrong.sum() / sqrt(seen_b)
    model.weights, model.bias = w * ratio, float(b)
    return model


def train_on(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 20_000, least: int = 0) -> NgramModel:
    """Train on at most ``rows`` labelled documents of at most ``chars`` characters, none of the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", 5) != 0, rows, chars, least)
    return train(list(sample["text"]), sample["label"].to_numpy())


def toxic_score(model: NgramModel, text: str = "text") -> Column:
    """The model's score of each whole text, as a column; nothing but the text goes into it."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, score near 1 for toxic texts.

    Edge cases: null and blank texts get the score of no n-grams; a null ``doc_id`` is not held out; repeated rows
    score alike; without usable labels all texts get one low score; labels of unknown documents, null labels and
    other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = train_on(docs, labels)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), toxic_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: NgramModel) -> DataFrame:
    """The rows, with all their columns, whose text scores under 0.5.

    Edge cases: null and blank texts have the score of no n-grams, which a model of both classes gives to texts to
    keep; very long texts are scored whole; repeated rows stay or go together; columns of any name, nulls in them and
    null ids are kept; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.where(toxic_score(model) < 0.5)
