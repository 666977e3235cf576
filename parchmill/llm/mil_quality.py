"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded: statistics of
its bytes and words beside hashed word shapes, through a learned tanh layer into h_k. A gated
attention weighs the passages,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),      z = sum_k a_k h_k,

and the document's score is sigmoid(c . z + b). All of it is learned together from document
labels, so the passages that give a document away get the weight.

The model is fitted on a bounded sample of labelled training rows; scoring is map-only and
looks at every passage. Null and empty texts are one passage without words. Repeated rows give
repeated results; copies of a training row count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import words as W
from parchmill.llm.sampling import remainder, sample, scored

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SAMPLE_ROWS = 5_000  # of each label
SAMPLE_CHARS = 20_000_000
PASSAGE_WORDS = 48
SHAPES = 64  # columns of hashed word shapes
HIDDEN, GATE = 24, 12
EPOCHS = 30
BATCH = 128
RATE = 0.01

# Byte kinds: lower, upper, digit, blank, line end, other ASCII, non-ASCII.
_KINDS = 7
_KIND = np.full(256, 5)
_KIND[128:] = 6
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 32]] = 3
_KIND[[10, 13]] = 4
_STATS = 12


def passages(data: np.ndarray) -> np.ndarray:
    """A row of features for each passage of a text."""
    hashes, starts, ends = W.words_of(data)
    n_words = len(hashes)
    n = max(1, -(-n_words // PASSAGE_WORDS))
    heads = np.arange(n) * PASSAGE_WORDS
    # A passage reaches from its first word to the next passage's; the first from the text's start.
    bounds = np.concatenate([[0], starts[heads[1:]], [len(data)]]) if n_words else np.array([0, len(data)])
    sizes = np.diff(bounds)
    owner_of_byte = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner_of_byte * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    owner = np.arange(n_words) // PASSAGE_WORDS
    lengths = ends - starts
    in_passage = np.bincount(owner, minlength=n)
    some = np.maximum(in_passage, 1)
    mean = np.bincount(owner, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths.astype(float) ** 2, n) / some - mean**2, 0))
    fresh = np.zeros(n_words, dtype=bool)
    fresh[np.unique(hashes, return_index=True)[1]] = True  # not seen before in the whole text
    own = np.unique(owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    distinct = np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=n)
    stats = np.empty((n, _STATS))
    stats[:, :_KINDS] = kinds / np.maximum(sizes, 1)[:, None]
    stats[:, 7] = np.log1p(in_passage) / 4
    stats[:, 8] = mean / 10
    stats[:, 9] = spread / 10
    stats[:, 10] = distinct / some
    stats[:, 11] = np.bincount(owner, fresh, n) / some
    # Shape of a word: its first byte's kind, its length, and the three bytes that follow it.
    shapes = np.zeros((n, SHAPES))
    if n_words:
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
        after = [np.where(_KIND[padded[ends + i]] < 2, 0, padded[ends + i]) for i in range(3)]
        key = _KIND[data[starts]] + 7 * np.minimum(lengths, 12) + 128 * after[0] + 2**15 * after[1] + 2**22 * after[2]
        # Two hashes of a word: what follows it alone, and with kind and length.
        for k, part in enumerate((key >> 7, key)):
            column = (W.mix(part.astype(np.uint64) + np.uint64(k)) % np.uint64(SHAPES // 2)).astype(np.int64) + k * SHAPES // 2
            shapes += np.bincount(owner * SHAPES + column, minlength=n * SHAPES).reshape(n, SHAPES)
        shapes /= some[:, None]
    return np.concatenate([stats, np.sqrt(shapes)], axis=1)


@dataclass
class Model:
    """Parameters by name, and mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Everything computed on the way for bags of passages; bag i starts at row first[i]."""
        p = self.weights
        h = np.tanh(x @ p["E"] + p["e"])
        content, gate = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (content * gate) @ p["w"]
        counts = np.diff(first, append=len(x))
        owner = np.repeat(np.arange(len(first)), counts)
        a = np.exp(s - np.maximum.reduceat(s, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "content": content, "gate": gate, "a": a, "z": z, "owner": owner, "logit": z @ p["c"] + p["b"]}

    def score(self, data: np.ndarray) -> float:
        if not self.weights:
            return self.bias
        x = (passages(data) - self.mean) / self.scale
        logit = float(self.forward(x, np.array([0]))["logit"][0]) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def _gradients(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    p, out = model.weights, model.forward(x, first)
    h, a, owner, content, gate = out["h"], out["a"], out["owner"], out["content"], out["gate"]
    error = (1 / (1 + np.exp(-np.clip(out["logit"], -35, 35))) - labels) / len(labels)
    dz = error[:, None] * p["c"]
    da = (h * dz[owner]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, first)[owner])
    d_content = ds[:, None] * p["w"] * gate * (1 - content**2)
    d_gate = ds[:, None] * p["w"] * content * gate * (1 - gate)
    dh = a[:, None] * dz[owner] + d_content @ p["V"].T + d_gate @ p["U"].T
    dx = dh * (1 - h**2)
    return {
        "E": x.T @ dx,
        "e": dx.sum(axis=0),
        "V": h.T @ d_content,
        "U": h.T @ d_gate,
        "w": (content * gate).T @ ds,
        "c": out["z"].T @ error,
        "b": error.sum(),
    }


def fit(rows: list, prior: float | None = None, seed: int = 0) -> Model:
    """Fit on sampled rows (text, label); ``prior`` is the share of label 1 among all training rows.

    Without rows of both labels the score is the prior (0.5 if unknown) everywhere.
    """
    labels = np.array([row.label for row in rows], dtype=np.float64)
    if prior is None:
        prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0), np.ones(0), prior)
    bags = [passages(x).astype(np.float32) for x in W.text_buffers(pa.array([row.text for row in rows], type=pa.string()))]
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, 0.0)
    del every
    rng = np.random.default_rng(seed)
    width = bags[0].shape[1]
    model.weights = {
        "E": rng.normal(0, width**-0.5, (width, HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "b": np.zeros(()),
    }
    speed = {name: np.zeros_like(value) for name, value in model.weights.items()}
    power = {name: np.zeros_like(value) for name, value in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            sizes = np.array([len(bags[i]) for i in picked])
            x = (np.concatenate([bags[i] for i in picked]) - model.mean) / model.scale
            slopes = _gradients(model, x, np.cumsum(sizes) - sizes, labels[picked])
            step += 1
            for name, slope in slopes.items():
                slope = slope + 1e-4 * model.weights[name]
                speed[name] = 0.9 * speed[name] + 0.1 * slope
                power[name] = 0.999 * power[name] + 0.001 * slope**2
                move = speed[name] / (1 - 0.9**step) / (np.sqrt(power[name] / (1 - 0.999**step)) + 1e-8)
                model.weights[name] = model.weights[name] - rate * move
    # The sample holds the labels in other shares than the corpus.
    mean = labels.mean()
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    model.bias = float(np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on at most SAMPLE_ROWS training rows of each label, SAMPLE_CHARS characters in all."""
    training = remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    return fit(*sample(docs, labels, label, training, SAMPLE_ROWS, SAMPLE_CHARS))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; the score depends on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = scored(docs.select("doc_id", "text"), lambda data: shared.value.score(data))
    return rows.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
