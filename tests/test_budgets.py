from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators.answer import answer
from parchmill.operators.backends import cut_to_tokens
from parchmill.operators.summarize import summarize


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize("separator", [" ", "\n", "\t", "  ", " \r\n", "\x0b"])
def test_a_budget_holds_whatever_the_separator(spark, separator):
    words = [f"w{i}" for i in range(5000)]
    cut = one(spark, separator.join(words), tx.first_tokens(F.col("text"), 1024))
    assert cut == separator.join(words[:1024])


def test_a_budget_bounds_texts_without_spaces(spark):
    assert one(spark, "я" * 100_000, tx.first_tokens(F.col("text"), 10)) == "я" * 320
    assert one(spark, "漢" * 40 + " b", tx.first_tokens(F.col("text"), 2)) == "漢" * 40
    assert [one(spark, t, tx.first_tokens(F.col("text"), 3)) for t in ("", "  ", " a  b ", None)] == ["", "", " a  b", None]
    assert one(spark, "a b", tx.first_tokens(F.col("text"), 0)) == ""


def by_letters():
    """A tokenizer whose tokens are three letters, and that cannot stand a star."""

    def cut(texts, n):
        if any("*" in t for t in texts):
            raise ValueError("star")
        return [t[: 3 * n] for t in texts]

    return cut


def test_a_tokenizer_takes_the_place_of_white_space(spark):
    df = spark.createDataFrame([(1, "abcdefghijkl"), (2, None), (3, "a * b c"), (4, "")], "i int, text string")
    rows = df.select("i", cut_to_tokens(F.col("text"), 2, by_letters).alias("cut")).collect()
    assert {r.i: r["cut"] for r in rows} == {1: "abcdef", 2: None, 3: "a *", 4: ""}
    config = S.GenerationConfig(max_input_tokens=5, min_tokens=1, max_tokens=50)
    made = summarize(df.filter("i = 1"), config=config, cutter=by_letters).first()
    assert made.summary == "abcdefghijkl"
    seen = answer(
        spark.createDataFrame([("a context", "why")], "text string, question string"),
        config=config,
        model=lambda: lambda texts: [f"saw {len(t)}" for t in texts],
        cutter=by_letters,
    ).first()
    assert seen.answer == "saw 15"


def test_newlines_cost_what_spaces_cost(spark):
    def seconds(separator):
        text = separator.join(f"word{i % 500}" for i in range(40_000))
        df = spark.range(200).select(F.lit(text).alias("text"), "id").repartition(4)
        best = 1e9
        for _ in range(3):
            started = time.perf_counter()
            summarize(df).select(F.sum(F.length("summary"))).collect()
            best = min(best, time.perf_counter() - started)
        return best

    spaces, newlines = seconds(" "), seconds("\n")
    assert newlines < 2 * spaces + 1
