from __future__ import annotations

import random

import pytest

from parchmill.llm import positional_index as index
from parchmill.session import cut_lineage
from tests.llm.test_words import plain_words


def brute(text, items, window):
    words = plain_words(text)
    hit, names = set(), set()
    for name, item in items:
        own = plain_words(item)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i : i + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def brute_near(text, items, window, slack):
    words, names = plain_words(text), set()
    for name, item in items:
        own = plain_words(item)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = sorted(own[i : i + window])
            for a in range(len(words)):
                for b in range(a + len(part), min(len(words), a + len(part) + slack) + 1):
                    stretch = list(words[a:b])
                    if all(stretch.count(word) >= part.count(word) for word in part):
                        names.add(str(name))
    return sorted(names)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    words = ["a", "B", "c", "dé", "e1", "F"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = [*enumerate(texts), (5, texts[5]), (None, "a b c"), (70, None), (71, ""), (72, "?!"), (73, "a B c. " * 4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((6, 5, 4, 3, 2, 8, 1, 4))]
    items += [(8, None), (9, ""), (None, "a b c dé"), (0, items[0][1])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "x")
    return docs, items, docs_df, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("segment_words", "block_chars"), [(1 << 18, 10**6), (100, 10)])
def test_phrases_as_by_brute_force(case, monkeypatch, segment_words, block_chars):
    docs, items, docs_df, items_df = case
    monkeypatch.setattr(index, "SEGMENT_WORDS", segment_words)
    segments = cut_lineage(index.build(docs_df))
    hits = index.search(segments, items_df, window=4, block_chars=block_chars)
    got = sorted(
        (str(r.id), r.n_words, r.n_hit, r["items"])
        for r in hits.select("id", "n_words", "items", index.covered("spans").alias("n_hit")).collect()
    )
    want = sorted((str(key), n, hit, names) for key, text in docs for n, hit, names in [brute(text, items, 4)])
    assert got == want


def test_proximity_as_by_brute_force(case):
    docs, items, docs_df, items_df = case
    small = docs_df.where("doc_id < 20")
    hits = index.search(cut_lineage(index.build(small)), items_df.where("item_id < 6"), window=4, slack=2)
    got = {r.id: r["items"] for r in hits.collect()}
    items = [item for item in items if item[0] is not None and item[0] < 6]
    assert got == {key: brute_near(text, items, 4, 2) for key, text in docs[:20]}


def test_empty_tables(case, spark):
    _, _, docs_df, items_df = case
    assert index.search(cut_lineage(index.build(docs_df.limit(0))), items_df).collect() == []
    none = index.contamination(index.search(cut_lineage(index.build(docs_df)), items_df.limit(0))).collect()
    assert len(none) == docs_df.count() and not any(r.contaminated or r.n_items or r.n_hit for r in none)
