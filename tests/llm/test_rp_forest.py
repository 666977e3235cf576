from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import rp_forest as forest
from parchmill.llm.queries import queries


def brute(rows, asked, k=5):
    rows = {key: np.array(v, dtype=float) for key, v in rows}
    out = {}
    for query in asked:
        q = rows[query]
        near = sorted((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), key) for key, v in rows.items() if key != query)
        out[query] = [key for _, key in near[:k]]
    return out


def answers(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(row.query_id, []).append(row.vec_id)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=6).astype(np.float32).astype(float).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(30)]  # a common vector
    bad = [(500, None), (550, [0.0] * 6), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (650, [float("nan")] * 6), (700, [float("inf")] * 6), (750, [1.0]), (None, good[1][1])]
    rows = [(key, v, "s") for key, v in good + bad + [good[3]]]
    got = answers(forest.neighbours(frame(spark, rows), F.col("id") % 5 == 0))
    assert got == brute(good, [key for key, _ in good if key % 5 == 0])
    few = [(0, [1.0, 0.0], ""), (5, [1.0, 1.0], ""), (7, [0.0, 1.0], "")]
    assert answers(forest.neighbours(frame(spark, few), F.col("id") % 5 == 0)) == {0: [5, 7], 5: [0, 7]}
    assert forest.neighbours(frame(spark, few).limit(0), F.col("id") % 5 == 0).collect() == []
    assert forest.neighbours(frame(spark, few[:1]), F.col("id") == 0).collect() == []


@pytest.mark.parametrize("block", [4096, 16])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "LEAF_ROWS", 32)
    monkeypatch.setattr(forest, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2_000)]
    df = forest.neighbours(frame(spark, [(key, v, "") for key, v in rows]), F.col("id") % 50 == 0, search=4_000)
    got, want = answers(df), brute(rows, range(0, 2_000, 50))
    recall = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert recall >= 0.9


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = answers(queries()["op10_rp_forest"](spark, sf_dir))
    want = brute(rows, [key for key, _ in rows if key % 50 == 0])
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
