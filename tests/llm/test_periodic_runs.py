from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from parchmill.llm import periodic_runs as R
from parchmill.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every stretch of every period, by comparing words; no run has a smaller period."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            stretch = words[first - q : i]
            smaller = any(all(a == b for a, b in zip(stretch, stretch[r:])) for r in range(1, q))
            if len(stretch) >= max(12, 2 * q) and not smaller:
                out.append((first - q, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, tails=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if tails and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        n,
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


COLUMNS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def repetitive(rng, n):
    """Words of few kinds with periodic stretches, whole copies and stray words."""
    kinds, words = rng.choice([1, 2, 2, 3, 6]), []
    while len(words) < n:
        period = rng.randint(1, 12) if rng.random() < 0.6 else rng.randint(12, 50)
        base = [rng.randrange(kinds) for _ in range(period)]
        words += [base[i % period] for i in range(rng.randint(1, 5 * period))]
        if rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)) :]
    return words[:n]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_many_texts_at_once(seed):
    rng, total = random.Random(seed), 0
    for _ in range(100):
        texts = [
            repetitive(rng, rng.randint(1, 160)) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randint(0, 120))]
            for _ in range(rng.randint(1, 5))
        ]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = np.array([w for t in texts for w in t], dtype=np.int64)
        expected = [(i, *run) for i, t in enumerate(texts) for run in plain_runs(t)]
        assert R.find_runs(words, offsets) == expected
        total += len(expected)
    assert total > 200


def test_touching_runs_and_words_of_neighbours():
    a, b = [0, 1] * 10, [1, 0] * 10
    for words in (a + b, a + a[:7] + b, [0] * 30 + [1] + [0] * 30, list(range(40)) * 2 + list(range(20))):
        assert R.find_runs(np.array(words), np.array([0, len(words)])) == [(0, *r) for r in plain_runs(words)]
    # A period that goes on in the next text ends with its own.
    assert R.find_runs(np.array([5] * 24), np.array([0, 11, 24])) == [(1, 0, 13, 1)]


def test_very_long_texts():
    for words in ([0] * 200_000, [0] * 30_000 + [1] + [0] * 30_000, list(range(70_000)) * 3):
        found = R.find_runs(np.array(words), np.array([0, len(words)]))
        if len(set(words)) == 1:
            assert found == [(0, 0, 200_000, 1)]
        elif len(words) == 210_000:
            assert found == [(0, 0, 210_000, 70_000)]
        else:
            assert found == [(0, 0, 30_000, 1), (0, 30_001, 30_000, 1)]


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a " * 11),
    (5, "a " * 12),
    (6, "a\x0bb\x0cc\x0d" * 9),
    (7, "x\x1cy\u00a0z " * 20),
    (8, "A a " * 8),
    (9, " lead " * 13 + "tail"),
    (9, " lead " * 13 + "tail"),
    (None, "b " * 30),
]


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, n_runs string, _text int"
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in EDGES], schema)
    rows = R.periodic_runs(frame).collect()
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows), key=repr)
    assert got == sorted(((i, *plain_row(i, t, tails=False)) for i, t in EDGES), key=repr)
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in by_id[5].runs] == [(0, 12, 1)] and by_id[5].collapsed == "a"
    assert by_id[4].runs == [] and by_id[4].collapsed == " ".join("a" * 11)
    assert R.periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_long_and_short_texts_in_slices(spark, monkeypatch):
    rng = random.Random(8)
    texts = [(i, " ".join(map(str, repetitive(rng, rng.choice([0, 5, 40, 300]))))) for i in range(120)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    whole = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in R.periodic_runs(frame, tails=True).collect()}
    assert whole == {i: plain_row(i, t) for i, t in texts}
    column = frame.toArrow().column("text").combine_chunks()
    monkeypatch.setattr(R, "BYTES_AT_ONCE", 300)
    ranges = list(R._sliced(column))
    assert len(ranges) > 20 and ranges[0][0] == 0 and ranges[-1][1] == 120
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: plain_row(d.doc_id, d.text) for d in docs if len(d.text) < 6000}
    rows = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    assert {i: rows[i] for i in short} == short
    assert sum(r[1] > 0 for r in short.values()) > 10
