"""Toxicity by a factorization machine over hashed terms.

    y(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

The linear part weighs terms, the factors weigh pairs of terms, so that an insult beside the
mention of a group counts more than the two apart. Terms are words and word beginnings (one
insult has many endings) as 64-bit hashes; x_i is 1 if a stretch of words has term i. A
document scores as its highest stretch, as a short insult in a long text is still one.

The model is fitted on a bounded sample of labelled training rows; scoring is map-only.
Null and empty texts have no term and score sigmoid(w0). Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import words as W
from parchmill.llm.sampling import remainder, sample, scored

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE_ROWS = 4_000  # of each label
SAMPLE_CHARS = 20_000_000
BEGINNINGS = (4, 5, 6)  # bytes
HALF = 16  # words; a stretch is two halves in a row
MIN_DOCUMENTS = 5  # of the sample that a term must stand in
FACTORS = 4
EPOCHS = 10
BATCH = 128
RATE = 0.1
SHRINK = 1e-5


def text_terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a text and the number of the word that each belongs to."""
    hashes, starts, ends = W.words_of(data)
    place = np.arange(len(hashes))
    terms, places = [hashes], [place]
    for n, size in enumerate(BEGINNINGS, 1):
        long = ends - starts > size
        if long.any():
            # A beginning lies within its word, so the word's own bytes are enough.
            at = starts[long]
            cut = W.windows(data, at, size)
            terms.append(W.mix(cut + np.uint64(n)))
            places.append(place[long])
    return np.concatenate(terms), np.concatenate(places)


@dataclass
class Machine:
    """Terms in order of their hash, with weights and factors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if the model lacks it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def stretches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Known terms of each stretch, once each, the number of their stretch, and how many there are."""
        terms, places = text_terms(data)
        halves = -(-(int(places.max()) + 1) // HALF) if len(places) else 0
        n = max(halves - 1, min(halves, 1))
        known = self.find(terms)
        half = places // HALF
        own = np.concatenate([half, half - 1])
        known = np.concatenate([known, known])
        keep = (known >= 0) & (own >= 0) & (own < n)
        pairs = np.unique(own[keep] << 32 | known[keep])
        return pairs & 0xFFFFFFFF, pairs >> 32, n

    def logits(self, known: np.ndarray, stretch: np.ndarray, n: int) -> np.ndarray:
        """Logit of every stretch; the bias alone if there is none."""
        if not n:
            return np.array([self.bias])
        linear = np.bincount(stretch, self.weights[known], n)
        squares = np.bincount(stretch, (self.factors[known] ** 2).sum(axis=1), n)
        sums = np.stack([np.bincount(stretch, self.factors[known, f], n) for f in range(self.factors.shape[1])])
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=0) - squares)

    def score(self, data: np.ndarray) -> float:
        logit = self.logits(*self.stretches(data)).max()
        return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def fit(rows: list, prior: float | None = None, seed: int = 0) -> Machine:
    """Fit a machine on sampled rows (text, label); ``prior`` is the share of label 1 among all rows.

    Without rows of both labels the score is the prior (0 if unknown) everywhere.
    """
    labels = np.array([row.label for row in rows], dtype=np.float64)
    if prior is None:
        prior = float(labels.mean()) if len(labels) else 0.0
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Machine(np.zeros(0, np.uint64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))

    texts = list(W.text_buffers(pa.array([row.text for row in rows], type=pa.string())))
    seen, seen_in = np.unique(np.concatenate([np.unique(text_terms(x)[0]) for x in texts]), return_counts=True)
    model = Machine(seen[seen_in >= MIN_DOCUMENTS], 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    docs = [model.stretches(data) for data in texts]

    # Start from the log odds of a term's documents: they point at the stretch that matters.
    n = len(model.terms)
    with_term = np.zeros((2, n))
    for (known, _, _), label in zip(docs, labels, strict=True):
        with_term[int(label), np.unique(known)] += 1
    share = (with_term + 0.5) / (np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 1)
    seen_in = with_term.sum(axis=0)
    model.weights = np.clip(np.log(share[1] / share[0]), -5, 5) * seen_in / (seen_in + 10)  # rare terms say little
    model.factors = rng.normal(0, 0.01, (n, FACTORS))
    weight_steps, factor_steps, bias_steps = np.full(n, 1e-3), np.full((n, FACTORS), 1e-2), 1e-3

    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            top, owner, logits = [], [], np.zeros(len(picked))
            for k, i in enumerate(picked):
                known, stretch, n_own = docs[i]
                every = model.logits(known, stretch, n_own)
                best = int(every.argmax())
                logits[k] = every[best]
                inside = known[stretch == best]
                top.append(inside)
                owner.append(np.full(len(inside), k))
            error = 1 / (1 + np.exp(-np.clip(logits, -35, 35))) - labels[picked]
            terms, owner = np.concatenate(top), np.concatenate(owner)
            factors = model.factors[terms]
            sums = np.stack([np.bincount(owner, factors[:, f], len(picked)) for f in range(FACTORS)], axis=1)
            used, at = np.unique(terms, return_inverse=True)
            slope = np.bincount(at, error[owner], len(used)) / BATCH + SHRINK * model.weights[used]
            weight_steps[used] += slope**2
            model.weights[used] -= RATE * slope / np.sqrt(weight_steps[used])
            pair = error[owner, None] * (sums[owner] - factors)
            slope = np.stack([np.bincount(at, pair[:, f], len(used)) for f in range(FACTORS)], axis=1) / BATCH
            slope += SHRINK * model.factors[used]
            factor_steps[used] += slope**2
            model.factors[used] -= 0.2 * RATE * slope / np.sqrt(factor_steps[used])
            slope = float(error.mean())
            bias_steps += slope**2
            model.bias -= RATE * slope / np.sqrt(bias_steps)
    # The sample holds the labels in other shares than the corpus.
    mean = labels.mean()
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    model.bias += float(np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)))
    model.weights, model.factors = model.weights.astype(np.float32), model.factors.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    """Fit on at most SAMPLE_ROWS training rows of each label, SAMPLE_CHARS characters in all."""
    training = remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    return fit(*sample(docs, labels, label, training, SAMPLE_ROWS, SAMPLE_CHARS))


def toxicity(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; the score depends on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = scored(docs.select("doc_id", "text"), lambda data: shared.value.score(data))
    return rows.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
