from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from parchmill.llm import suffix_dedup as dedup
from parchmill.llm.queries import queries
from parchmill.session import cut_lineage
from tests.llm.test_words import plain_words


def windows(docs, k):
    """Words of each document that lie in k words which an earlier document has."""
    first, out = {}, {}
    for key, text in sorted(docs.items()):
        words = plain_words(text)
        out[key] = set()
        for at in range(len(words) - k + 1):
            part = tuple(words[at : at + k])
            if first.setdefault(part, key) != key:
                out[key] |= set(range(at, at + k))
    return out


def spans_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumn("doc", dedup.document_key(F.col("doc_id"), F.col("text")))
    return docs, keyed, dedup.repeats(keyed)


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    passages = [[word() for _ in range(n)] for n in (51, 60, 140, 49)]
    docs = {}
    for i in range(30):
        parts = [[word() for _ in range(rng.randint(0, 90))] for _ in range(3)]
        parts.insert(1, passages[i % 4] if i % 3 else [])
        docs[i] = ", ".join(" ".join(part) for part in parts if part)
    docs[30], docs[31], docs[32] = docs[4], "", "é " * 10
    rows = [*docs.items(), (7, docs[7]), (None, None), (40, None)]
    _, _, found = spans_of(spark, rows)
    got = {key: set() for key in docs}
    for row in found.collect():
        for span in row.spans:
            assert span.first_doc_id < row.doc_id and span.end_word - span.start_word >= dedup.MIN_WORDS
            got[row.doc_id] |= set(range(span.start_word, span.end_word))
    must, may = windows(docs, dedup.MIN_WORDS), windows(docs, dedup.KEY)
    assert all(must[key] <= got[key] <= may[key] for key in docs)
    assert sum(map(len, got.values())) > 500


def test_cut_text(spark):
    passage = " ".join(f"Wörd{i}" for i in range(60))
    rows = [(1, f"Erst. {passage}. Ende"), (2, f"Ah, {passage}! Öh"), (3, passage), (4, "short")]
    docs, keyed, found = spans_of(spark, rows)
    cut = keyed.join(found.select("doc", "spans"), "doc").select("doc_id", dedup.without_spans(F.col("text"), F.col("spans")))
    assert sorted(map(tuple, cut.collect())) == [(2, "Ah, ! Öh"), (3, "")]


def test_repeats_within_a_document_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    _, _, found = spans_of(spark, [(1, f"{passage} x {passage}"), (2, "a b")])
    assert found.collect() == []
    _, _, found = spans_of(spark, [(2, f"{passage} x {passage}"), (1, passage)])
    assert [[(s.start_word, s.end_word) for s in r.spans] for r in found.collect()] == [[(0, 70), (71, 141)]]
    docs, keyed, _ = spans_of(spark, [(1, "a")])
    assert dedup.repeats(keyed.limit(0)).collect() == []


def test_an_earlier_holder_of_a_part_hides_no_repeat(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    docs, key = {}, 0
    for n in (50, 55, 60, 70):
        passage = [word() for _ in range(n)]
        # Every 30 words stand in an earlier document of their own, 50 words only in the last two.
        for at in range(0, n - dedup.KEY + 1):
            docs[key] = " ".join([word() for _ in range(30)] + passage[at : at + dedup.KEY] + [word() for _ in range(30)])
            key += 1
        docs[key] = " ".join([word(), *passage, word()])
        docs[key + 1] = " ".join([word(), word(), *passage])
        key += 2
    _, _, found = spans_of(spark, list(docs.items()))
    got = {row.doc_id: {x for s in row.spans for x in range(s.start_word, s.end_word)} for row in found.collect()}
    assert got == {key: words for key, words in windows(docs, dedup.MIN_WORDS).items() if words} and len(got) == 4


def overlapping(seed, n):
    """Documents cut from three long passages, so that a key stands in many contexts."""
    rng = random.Random(seed)
    long = [[f"w{seed}x{i}x{j}" for j in range(220)] for i in range(3)]
    docs = {}
    for key in range(n):
        words = []
        for _ in range(rng.randint(1, 4)):
            passage, at = rng.choice(long), rng.randint(0, 160)
            words += passage[at : at + rng.randint(20, 120)] + [f"u{key}x{rng.random()}"] * rng.randint(0, 2)
        docs[key] = " ".join(words)
    return docs


def covered(row):
    return {x for span in row.spans for x in range(span.start_word, span.end_word)}


def test_keys_in_many_contexts(spark):
    docs = overlapping(5, 120) | {200 + i: text for i, text in enumerate([overlapping(5, 120)[3]] * 40)}
    _, _, found = spans_of(spark, [*docs.items(), *list(docs.items())[:9]])
    rows = found.collect()
    assert {row.doc_id: covered(row) for row in rows} == {
        key: words for key, words in windows(docs, dedup.MIN_WORDS).items() if words
    }
    assert len(rows) == len({row.doc_id for row in rows})
    for row in rows:
        text = docs[row.doc_id].encode()
        for span in row.spans:
            words = plain_words(text[span.start_byte : span.end_byte].decode())
            assert words == plain_words(docs[row.doc_id])[span.start_word : span.end_word]


def test_texts_that_go_on_repeating_a_few_words(spark):
    docs = {}
    for key in range(12):
        own = " ".join(f"u{key}x{i}" for i in range(40))
        docs[key] = f"{own} {'is onhe. ' * (200 + 10 * key)} {own} v{key} {'a b c. ' * 100} {own}"
    docs[20] = "x y " * 5_000  # in no other text
    _, keyed, found = spans_of(spark, list(docs.items()))
    rows = found.collect()
    assert {row.doc_id: covered(row) for row in rows} == {
        key: words for key, words in windows(docs, dedup.MIN_WORDS).items() if words
    }
    assert {span.first_doc_id for row in rows for span in row.spans} == {0} and len(rows) == 11
    # A row for every repetition made 289 to 402 a text.
    places = {row.doc_id: row["count"] for row in dedup.suffixes(keyed).groupBy("doc_id").count().collect()}
    assert max(places.values()) < 150
    members = cut_lineage(dedup.shared_suffixes(keyed))
    assert {row.doc_id for row in members.select("doc_id").collect()} == set(range(12))
    extended = dedup.extensions(keyed, dedup.classes_of(members)).groupBy("doc_id").count().collect()
    assert extended and max(row["count"] for row in extended) < 250


def test_chains():
    key = lambda *values: np.array(values, dtype=np.uint64)
    # Of five places of a class the second to fourth are one row; one apart, and one of another key, stay.
    begin, end = dedup.chains(
        key(5, 5, 7, 5, 5, 5), key(1, 1, 1, 1, 1, 1), np.array([0, 2, 3, 4, 54, 105]), np.array([50, 52, 53, 54, 104, 155])
    )
    assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(0, 0), (1, 4), (5, 5), (2, 2)]
    assert [x.tolist() for x in dedup.chains(key(), key(), np.array([]), np.array([]))] == [[], []]


def test_a_very_long_text_and_ids_that_are_null(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = {1: long, 2: long[:4_000].rsplit(" ", 1)[0], 3: "before " + long}
    _, _, found = spans_of(spark, [*docs.items(), (None, " ".join(long.split()[100:170]))])
    got = {row.doc_id: [(s.start_word, s.end_word, s.first_doc_id) for s in row.spans] for row in found.collect()}
    n = len(docs[2].split())
    assert got == {1: [(100, 170, None)], 2: [(0, n, 1)], 3: [(1, 300_001, 1)]}


def test_stretches():
    at = lambda *values: np.array(values)
    begins, ends = dedup.stretches(at(0, 5, 30, 60, 200), at(70, 55, 60, 110, 250))
    assert (begins.tolist(), ends.tolist()) == ([0, 4], [3, 4])
    assert [x.tolist() for x in dedup.stretches(at(0, 10), at(100, 60))] == [[0], [0]]
    assert [x.tolist() for x in dedup.stretches(at(), at())] == [[], []]


def test_query(spark, sf_dir):
    docs = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for row in queries()["op3_suffix_dedup"](spark, sf_dir).collect():
        assert row.first_doc_id < row.doc_id
        got.setdefault(row.doc_id, set()).update(range(row.start_word, row.start_word + row.n_words))
    assert got == {key: words for key, words in windows(docs, dedup.MIN_WORDS).items() if words} and got
