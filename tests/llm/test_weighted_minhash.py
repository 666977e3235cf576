from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from parchmill.llm import weighted_minhash as minhash


def data(text):
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def test_samples_estimate_the_similarity():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(900)]
    other = [word if rng.random() > 0.03 else f"x{i}" for i, word in enumerate(words)]
    idf = np.linspace(0.5, 5, minhash.IDF_COLUMNS, dtype=np.float32)
    a, b = minhash.weigh(data(" ".join(words)), idf), minhash.weigh(data(" ".join(other)), idf)
    exact = minhash.weighted_jaccard(a, b)
    agree = np.mean(minhash.samples(*a) == minhash.samples(*b))
    assert abs(agree - exact) < 0.2 and minhash.weighted_jaccard(a, a) == pytest.approx(1)
    # A text longer than a step gives what one step would give.
    before, minhash.AT_ONCE = minhash.AT_ONCE, 10_000
    try:
        assert (minhash.samples(*a) == minhash.samples(*a)).all()
        whole = minhash.samples(*a)
        minhash.AT_ONCE = 50
        assert (minhash.samples(*a) == whole).all()
    finally:
        minhash.AT_ONCE = before


def test_classes_as_by_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    docs = {}
    for i in range(120):
        words = [w if rng.random() > 0.01 * (i % 4) else f"e{rng.randint(0, 99)}" for w in base[i % 12]]
        docs[i] = " ".join(words)
    docs |= {200: docs[0].upper(), 201: docs[3], 202: None, 203: "", 204: "", 205: "?"}
    rows = [(key, text, "x") for key, text in docs.items()] + [(201, docs[3], "y"), (None, docs[3], "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _class string").select("doc_id", "text")
    got = minhash.classes(table, ["doc_id"]).collect()
    assert len(got) == len(rows)

    idf = minhash.inverse_frequency(*minhash.document_frequency(table))
    weighed = {key: minhash.weigh(data(text), idf) for key, text in docs.items()}
    of = {key: key for key in docs}
    for a, b in combinations(sorted(docs), 2):
        if len(weighed[a][0]) and minhash.weighted_jaccard(weighed[a], weighed[b]) >= minhash.SIMILARITY:
            old, new = max(of[a], of[b]), min(of[a], of[b])
            of = {key: new if label == old else label for key, label in of.items()}
    for row in got:
        assert row.class_id == of[201 if row.doc_id is None else row.doc_id]
    firsts = [row.doc_id for row in got if row.first]
    assert sorted(firsts) == sorted(set(of.values()))


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(table, ["doc_id"]).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "head long, member long")
    found = dict(map(tuple, minhash.components(edges).collect()))
    assert set(found.values()) == {0, 40} and len(found) == 23


def links_of_windows(spark, starts, bucket_place, samples):
    """Links of texts that are 1,000 words of one row of words each, and meet in one band alone."""
    words = [f"w{i}" for i in range(max(starts) + 1000)]
    docs = [(key, " ".join(words[start : start + 1000])) for key, start in enumerate(starts)]
    signed = []
    for key in range(len(starts)):
        bands = [1000 * (key + 1) + place for place in range(minhash.BANDS)]
        bands[bucket_place] = 7
        signed.append((key, bands, np.array(samples[key], dtype="<u4").tobytes()))
    table = spark.createDataFrame(signed, "_key long, _bands array<long>, _samples binary")
    texts = spark.createDataFrame(docs, "_key long, text string")
    found = minhash.links(table, texts, np.ones(minhash.IDF_COLUMNS, dtype=np.float32)).distinct()
    idf = np.ones(minhash.IDF_COLUMNS, dtype=np.float32)
    weighed = [minhash.weigh(data(text), idf) for _, text in docs]
    want = {
        (a, b) for a, b in combinations(range(len(docs)), 2)
        if minhash.weighted_jaccard(weighed[a], weighed[b]) >= minhash.SIMILARITY
    }
    return {tuple(sorted(pair)) for pair in found.collect()}, want


def test_a_text_unlike_the_head_meets_those_like_it(spark):
    # h - x 0.95, x - y 0.81, h - y 0.77; h is the head.
    same = [[place for place in range(minhash.HASHES)]] * 3
    got, want = links_of_windows(spark, [0, 26, 131], 0, same)
    assert got == want == {(0, 1), (1, 2)}


@pytest.mark.parametrize("place", [0, minhash.BANDS - 1])
def test_pairs_of_a_hot_bucket_meet(spark, monkeypatch, place):
    monkeypatch.setattr(minhash, "GROUP", 6)
    starts = [2000 * (i // 2) + 60 * (i % 2) for i in range(40)]
    # All share 4 samples, the two of a pair 45.
    samples = [[1] * 4 + [100 + i // 2] * 41 + [1000 + i] * 19 for i in range(40)]
    got, want = links_of_windows(spark, starts, place, samples)
    assert got == want and len(want) == 20
    largest = []
    nodes = spark.createDataFrame(
        [(key, np.array(own, dtype="<u4").tobytes()) for key, own in enumerate(samples)], "_key long, _samples binary"
    )
    for row in minhash._rarest(nodes).groupBy("bucket").count().collect():
        largest.append(row["count"])
    assert max(largest) == 2


def test_a_hot_bucket_of_like_samples_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 8)
    samples = [list(range(minhash.HASHES))] * 16
    got, want = links_of_windows(spark, [105 * i for i in range(16)], minhash.BANDS - 1, samples)
    assert got == want and len(want) == 15


def test_a_group_gives_links_and_no_pairs(spark, monkeypatch):
    """All samples agree, but only the last two texts are similar."""
    pairs, compare = [], minhash.compare
    monkeypatch.setattr(minhash, "compare", lambda rows, *more: pairs.append(rows.count()) or compare(rows, *more))
    got, want = links_of_windows(spark, [*range(0, 5700, 300), 5460], 0, [list(range(minhash.HASHES))] * 20)
    assert got == want == {(18, 19)}
    assert sum(pairs) < 20


def test_texts_of_many_bytes_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_BYTES", 20_000)
    got, want = links_of_windows(spark, [105 * i for i in range(12)], 0, [list(range(minhash.HASHES))] * 12)
    assert len(want) == 11 and got == want


def test_similar_to_one_text_at_once():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        shingles = np.sort(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64)
        texts.append((shingles, rng.integers(1, 4, len(shingles)) * np.float32(0.1)))
    for least in (0.2, 0.5, minhash.weighted_jaccard(texts[0], texts[1])):
        want = [minhash.weighted_jaccard(texts[0], other) >= least for other in texts]
        assert minhash.similar_to(texts[0], texts, least).tolist() == want
