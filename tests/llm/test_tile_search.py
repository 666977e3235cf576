from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from parchmill.llm import tile_search as S
from parchmill.llm.queries import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def plain_ranking(documents, items, k=10):
    """Term by term, with Python's integers."""
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    n_docs = sum(1 for _, bag in bags if bag)
    n_all = sum(sum(bag.values()) for _, bag in bags)
    frequency = Counter(t for _, bag in bags for t in bag)
    asked: dict = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, wanted in asked.items():
        scored = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in wanted & bag.keys():
                m = 100 - 90 + (90 * n * n_docs) // n_all
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def made_up(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "x1", "9"] + [f"w{i}" for i in range(40)]
    text = lambda top: " ".join(rng.choice(words[: rng.choice([3, 6, 46])]) for _ in range(rng.randint(0, top)))
    documents = [(i, text(30)) for i in range(n)]
    documents += [(i, documents[0][1]) for i in range(n, n + 40)] + [(5, documents[7][1]), (None, documents[9][1]), (900, None), (901, ""), (902, "-- !")]
    items = [(i, text(12)) for i in range(20)] + [(20, None), (21, ""), (3, "w1 w2 w3"), (None, "w4 w5"), (22, "nowhere"), (23, documents[0][1])]
    rng.shuffle(documents)
    return documents, items


def search(spark, documents, items, **more):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in documents], "doc_id bigint, text string, score int, item_id string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    return sorted((tuple(r) for r in S.search(docs.repartition(5), asked, **more).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_term_by_term_scores(spark, seed):
    documents, items = made_up(seed)
    assert search(spark, documents, items) == plain_ranking(documents, items)


def test_groups_of_items_and_other_k(spark):
    documents, items = made_up(3, 120)
    assert search(spark, documents, items, k=3, group_items=7) == plain_ranking(documents, items, 3)
    assert search(spark, documents, items, k=1, group_terms=20) == plain_ranking(documents, items, 1)


def test_tiles_of_terms_and_documents(spark, monkeypatch):
    documents, items = made_up(4, 200)
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").coalesce(1)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    rows = S.item_terms(asked).toArrow()
    batches = docs.toArrow().to_batches()
    found = {}
    for sides in ((256, 4096, 256), (3, 5, 7)):
        for name, value in zip(("ITEMS", "TERMS", "DOCS"), sides):
            monkeypatch.setattr(S, name, value)
        hashes = np.unique(np.concatenate([np.array(x).view(np.uint64) for x in rows.column("terms").to_pylist()]))
        columns = [np.searchsorted(hashes, np.array(x).view(np.uint64)) for x in rows.column("terms").to_pylist()]
        tiles = S._weight_tiles(columns, np.arange(1, len(hashes) + 1))
        out = S._search(hashes, tiles, rows.column("item_id").combine_chunks(), 200, 3000, 10)(iter(batches))
        found[sides] = sorted((tuple(r.values()) for b in out for r in b.to_pylist()), key=repr)
    first, second = found.values()
    assert first == second and len(first) > 100


def test_partial_sums_stay_exact():
    heavy = S.Weights(0, 1, np.arange(10), np.arange(10), np.zeros(10, np.int64), np.full(10, 1 << 32))
    parts = heavy.dense()
    assert sum(len(c) for c, _ in parts) == 10
    assert all(int(m.sum(axis=0).max()) * 1_000_000 < 1 << 53 for _, m in parts) and len(parts) > 1


def test_ties_at_the_cut(monkeypatch):
    monkeypatch.setattr(S, "HELD", 4)
    best = S.Best(1, 3)
    for ids in ([9, 8], [7, 6, 5], [4], [3, 2]):
        best.add(0, np.full((len(ids), 1), 50), np.array(ids), np.zeros(len(ids), bool))
    best.add(0, np.array([[50], [60], [49]]), np.array([0, 10, 1]), np.array([True, False, False]))
    assert [x.tolist() for x in best.cut()] == [[0] * 3, [60, 50, 50], [False] * 3, [10, 2, 3]]


def test_nothing_to_find(spark):
    documents, items = made_up(5, 20)
    assert search(spark, [], items) == [] and search(spark, documents, []) == []
    assert search(spark, documents, [(1, None)]) == [] and search(spark, [(1, None)], items) == []


def test_very_long_text(spark):
    documents = [(1, "long " * 400_000 + "needle"), (2, "needle"), (3, "hay")]
    assert search(spark, documents, [(1, "needle")]) == plain_ranking(documents, [(1, "needle")])


def test_query_equals_term_by_term_scores(spark, sf_dir):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]
    rows = sorted((tuple(r) for r in queries()["op11_tile_search"](spark, sf_dir).collect()), key=repr)
    assert rows == plain_ranking(read("documents", "doc_id"), read("benchmark", "item_id"))
