from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hashes(text):
    return W.words_of(next(W.text_buffers(pa.array([text], type=pa.string()))))[0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB1 éß漢.,\n-😀", max_size=80))
def test_words_are_those_of_the_pattern(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    _, starts, ends = W.words_of(data)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert ["".join(plain_words(word)) for word in found] == plain_words(text)
    seen = dict(zip(plain_words(text), hashes(text).tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
    assert all(seen[word] == int(h) for word, h in zip(plain_words(text), hashes(text), strict=True))


def test_pieces_do_not_show(monkeypatch):
    text = "alpha Beta gamma-delta " * 200 + "x" * 500 + " end"
    whole = hashes(text)
    monkeypatch.setattr(W, "PIECE", 64)
    assert hashes(text).tolist() == whole.tolist()


def test_null_and_slices():
    column = pa.array(["a b", None, "", "c"]).slice(1)
    assert [len(W.words_of(x)[0]) for x in W.text_buffers(column)] == [0, 0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9))
def test_minimisers(keys, window):
    keys = np.array(keys, dtype=np.uint64)
    width = min(window, len(keys))
    want = {
        i
        for start in range(len(keys) - width + 1)
        for i in range(start, start + width)
        if width and keys[i] == keys[start : start + width].min()
    }
    assert W.minimisers(keys, window).tolist() == sorted(want)


def test_runs_and_short_shingles():
    h = hashes("a b c d e f g h i j a b c d e f g h i j")
    for k in (5, 10):
        r = W.runs(h, k)
        assert len(r) == 21 - k and r[0] == r[10] and len(set(r.tolist())) == 10
    assert len(W.shingles(hashes("a b"), 5)) == 1 and len(W.shingles(hashes(""), 5)) == 0
