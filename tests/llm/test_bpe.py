from __future__ import annotations

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import bpe
from parchmill.llm.queries import queries, vocabulary

RANKS, PATTERN = vocabulary()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode([text])[0], dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeht ion\n'!1é漢", max_size=300))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "theion" * 4_000, " " * 9_000, "ab" * 10_000, "<|endoftext|>", "É" * 129])
def test_long_pre_tokens(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_cache_and_batches_do_not_show(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    codec = bpe.Codec(RANKS, PATTERN)
    texts = ["one two three", None, "", "two three four five", "one " * 50]
    for _ in range(3):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(texts)]
        assert got == [LIBRARY.encode_ordinary(text or "") for text in texts]


def test_rank_queue_orders_by_rank_and_place():
    queue, rng = bpe.RankQueue(5_000), np.random.default_rng(0)
    pairs = [(int(r), int(p)) for r, p in zip(rng.integers(0, 5_000, 900), rng.integers(0, 99, 900), strict=True)]
    for rank, place in pairs:
        queue.push(rank, place)
    assert [queue.pop() for _ in pairs] == sorted(pairs)
    assert queue.pop() is None


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    with pytest.raises(ValueError):
        bpe.encode(df, RANKS, PATTERN)
    coded = bpe.decode(bpe.encode(df.drop("ids"), RANKS, PATTERN), RANKS, PATTERN)
    assert sorted((bytes(r.data).decode(), len(r.ids)) for r in coded.collect()) == [
        ("", 0), ("", 0), ("Hello world", 2), ("Hello world", 2)
    ]
    assert bpe.round_trip(df.drop("ids").limit(0), RANKS, PATTERN).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op9_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = np.array(LIBRARY.encode_ordinary(texts[row.doc_id]), dtype="<u4")
        assert row.n_tokens == len(want) and row.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
