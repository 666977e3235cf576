from __future__ import annotations

import hashlib

import numpy as np

import corpus_pipeline
from parchmill.llm import mil_quality, positional_index, suffix_dedup, weighted_minhash
from parchmill.llm import words as W
from parchmill.llm.queries import vocabulary
from parchmill.llm.sampling import remainder, sample
from parchmill.session import cut_lineage
from pyspark.sql import functions as F
from tests.llm.test_positional_index import brute
from tests.llm.test_suffix_dedup import windows
from tests.llm.test_words import plain_words

SF_DIR = "/root/testdata/sf0.001"


def data(text):
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut_lineage(stage(spark, steps[-1], SF_DIR)))
    assert all(step.columns == docs.columns for step in steps[:-1]) and len(stages) == 5
    tables = [{r.doc_id: r.text for r in step.collect()} for step in steps[:-1]]

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    training = remainder(F.col("doc_id"), mil_quality.FOLDS) != mil_quality.HELD_OUT
    model = mil_quality.fit(*sample(docs, labels, "quality", training, mil_quality.SAMPLE_ROWS, mil_quality.SAMPLE_CHARS))
    assert set(tables[1]) == {k for k, text in tables[0].items() if model.score(data(text)) >= mil_quality.THRESHOLD}

    idf = weighted_minhash.inverse_frequency(*weighted_minhash.document_frequency(steps[1]))
    weighed = {k: weighted_minhash.weigh(data(text), idf) for k, text in tables[1].items()}
    of = {k: k for k in weighed}
    for a in sorted(of):
        for b in sorted(of):
            if a < b and weighted_minhash.weighted_jaccard(weighed[a], weighed[b]) >= weighted_minhash.SIMILARITY:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {k: new if label == old else label for k, label in of.items()}
    assert set(tables[2]) == {k for k, label in of.items() if k == label}

    must = windows(tables[2], suffix_dedup.MIN_WORDS)
    for key, text in tables[2].items():
        before, after = len(plain_words(text)), len(plain_words(tables[3][key]))
        assert before - after >= 0.8 * len(must[key]) and (before == after) == (text == tables[3][key])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = set()
    for key, text in tables[3].items():
        n, hit, _ = brute(text, items, positional_index.WINDOW) if any(i[1][:20].lower() in text.lower() for i in items) else (1, 0, [])
        full = n if hit else len(W.words_of(data(text))[0])
        if not (hit and 20 * hit >= full):
            clean.add(key)
    assert set(tables[4]) <= clean

    last = {r.doc_id: r for r in steps[-1].collect()}
    assert set(last) == set(tables[4])
    for key, text in tables[4].items():
        assert last[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert vocabulary()[0]


def test_odd_columns_nulls_and_empty_tables(spark):
    rows = [(1, None, "x", 1.5), (None, "a b c", None, None), (2, "", "y", 0.0), (2, "", "y", 0.0), (3, "w " * 300, "z", 1.0)]
    odd = "doc_id long, text string, _bands string, score double, lang string, source string, spans int, n_chars long"
    docs = spark.createDataFrame([(*row, "en", "s", 1, 5) for row in rows], odd)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF_DIR)
            assert out.schema.names == docs.columns and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF_DIR).count() == table.count()


def test_no_text_is_lost_however_the_table_is_planned(spark):
    words = [f"{chr(97 + i % 26)}{i}" for i in range(3000)]
    texts = [" ".join(words[i * 29 : i * 29 + 25]) for i in range(100)]
    rows = [(i, texts[i % 100], f"s{i % 7}") for i in range(300)] + [(5, texts[5], "again"), (None, texts[6], "x"), (7, "", "y"), (7, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = spark.createDataFrame([(f"s{i}", i) for i in range(7)] + [("again", 8), ("x", 9), ("y", 10)], "source string, number int")
    for table in (docs, docs.repartition(7), docs.repartition(5, "source"), docs.join(sources, "source").orderBy("number")):
        kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table, SF_DIR)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert sorted(got) == sorted([(i, texts[i]) for i in range(100)] + [(7, "")] * 2)
        assert kept.columns == table.columns
