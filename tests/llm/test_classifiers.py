from __future__ import annotations

import random
import zlib
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import mil_quality, toxicity_fm
from parchmill.llm.queries import queries
from parchmill.llm.sampling import sample

Row = namedtuple("Row", "text label")


def area(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def data(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def corpus(n, seed, toxic):
    """A label needs an insult beside a group (toxic), or prose without shouting (quality)."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("lor", "mes", "nit", "pul", "ras", "tev")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        label = i % 2
        if toxic:
            at = rng.randint(0, len(text))
            text[at:at] = ["insultA", "groupB"] if label else [rng.choice(["insultA", "groupB"])]
        elif not label:
            at = rng.randint(0, len(text) // 2)
            text[at:] = [word.upper() + "!!" for word in text[at:]]
        rows.append(Row(" ".join(text), label))
    return rows


@pytest.mark.parametrize(("module", "toxic"), [(toxicity_fm, True), (mil_quality, False)])
def test_learns_and_holds_for_unseen_rows(module, toxic):
    model = module.fit(corpus(600, 1, toxic))
    test = corpus(200, 2, toxic)
    assert area([model.score(data(row.text)) for row in test], [row.label for row in test]) > 0.95


@pytest.mark.parametrize("module", [toxicity_fm, mil_quality])
def test_edge_cases(module):
    for rows in ([], [Row("a", 1)], [Row("", 0), Row("b", 0)]):
        assert 0 <= module.fit(rows, 0.25 if not rows else None).score(data("x y")) <= 1
    model = module.fit([Row("", 0), Row("good words here", 1), Row("bad", 0), Row("x " * 5_000, 1)])
    for text in ("", "?!", "é" * 10, "word " * 50_000, "W" * 100_000):
        assert 0 <= model.score(data(text)) <= 1


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = mil_quality.fit(corpus(8, 3, False))
    x, first, labels = rng.normal(size=(7, len(model.mean))), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        logit = model.forward(x, first)["logit"]
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    slopes = mil_quality._gradients(model, x, first, labels)
    for name, value in model.weights.items():
        at = tuple(int(rng.integers(n)) for n in np.shape(value))
        before = np.array(value)
        model.weights[name] = before.copy()
        model.weights[name][at] += 1e-5
        up = loss()
        model.weights[name][at] -= 2e-5
        down = loss()
        model.weights[name] = before
        assert (up - down) / 2e-5 == pytest.approx(float(np.asarray(slopes[name])[at]), abs=1e-6)


def test_sample_is_bounded_and_keeps_to_the_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "z") for i in range(400)] + [(7, None, "z"), (None, "n", "z")],
                                 "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)] + [(8, False), (9, None), (None, True)],
                                   "doc_id long, toxic boolean")
    rows, prior = sample(docs, labels, "toxic", F.col("doc_id") % 2 == 0, 30, 10**6)
    assert {int(row.text.split()[1]) % 2 for row in rows} == {0} and prior == pytest.approx(0.5, abs=0.01)
    assert 0 < sum(row.label for row in rows) <= 30 and len(rows) <= 60
    rows, _ = sample(docs, labels, "toxic", F.lit(True), 400, 900)
    assert sum(len(row.text) for row in rows) <= 900
    assert sample(docs, labels.limit(0), "toxic", F.lit(True), 30, 100) == ([], None)


@pytest.mark.parametrize(("name", "label", "folds", "held"), [("op6_mil_quality", "quality", 5, 0), ("op7_toxicity_fm", "toxic", 4, 2)])
def test_queries(spark, name, label, folds, held):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries()[name](spark, sf_dir).collect()
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % folds == held)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
    unseen = [row for row in rows if row.held_out and row.doc_id in marks]
    # With some dozens of rows of the rarer label toxicity can only be better than chance.
    assert area([row.score for row in unseen], [marks[row.doc_id] for row in unseen]) > (0.95 if label == "quality" else 0.6)
