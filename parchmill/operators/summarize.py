"""Extractive summaries as one map-only projection per text.

Everything a summary needs is in its own row, so the sentence ranking runs on
arrays inside the row. Exploding to tokens and regrouping would shuffle several
times the volume of the text, and would put the tokens of a hot text in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators.backends import CutterFactory, ModelFactory, cut_to_tokens, run_model

SCORE_SCALE = 1_000_000


def _repeated(words: Column) -> Column:
    """struct<words, counts> of the words that occur more than once.

    Most words of a text occur once, and a lookup in an array costs its length,
    so those are left out and counted as 1 by the reader.
    """

    def from_sorted(ordered: Column) -> Column:
        n = F.size(ordered)
        # 1-based positions at which a run of two or more equal words ends.
        run_ends = F.when(
            n > 1,
            F.filter(
                F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
                lambda i: (F.get(ordered, i - 1) == F.get(ordered, i - 2))
                & ((i == n) | (F.get(ordered, i) != F.get(ordered, i - 1))),
            ),
        ).otherwise(F.array().cast("array<int>"))
        return tx.let(
            run_ends,
            lambda ends: F.struct(
                F.transform(ends, lambda i: F.get(ordered, i - 1)).alias("words"),
                F.transform(ends, lambda i: i - F.array_position(ordered, F.get(ordered, i - 1)) + 1).alias("counts"),
            ),
        )

    return tx.let(F.sort_array(words), from_sorted)


def _ranked(sentences: Column, keep: int) -> Column:
    """The ``keep`` best sentences as array<struct<neg_score, pos, n, text>>, best first."""

    def score(words: Column, tf: Column) -> Column:
        total = F.aggregate(
            words,
            F.lit(0).cast("bigint"),
            lambda acc, w: acc
            + F.coalesce(F.get(tf["counts"], F.array_position(tf["words"], w).cast("int") - 1), F.lit(1)),
        )
        return F.call_function("div", total * F.lit(SCORE_SCALE), F.size(words))

    # sort_array orders structs by their fields: best score first, then text order.
    return tx.let(
        _repeated(F.flatten(sentences["words"])),
        lambda tf: F.slice(
            F.sort_array(
                F.transform(
                    sentences,
                    lambda s, i: F.struct(
                        (-score(s["words"], tf)).alias("neg_score"),
                        i.alias("pos"),
                        F.size(s["words"]).alias("n"),
                        s["text"].alias("text"),
                    ),
                )
            ),
            1,
            keep,
        ),
    )


def summarize(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "summary",
    ok_col: str = "ok",
    config: S.GenerationConfig = S.SUMMARY,
    model: ModelFactory | None = None,
    cutter: CutterFactory | None = None,
) -> DataFrame:
    """Add a summary and an ok flag to every row. ``cutter`` counts the tokens of the input budget.

    Without a model: sentences of the input budget are scored by the mean document
    frequency of their words; the best one is kept, and further ones in score
    order while fewer than ``min_tokens`` are reached and ``max_tokens`` is not
    passed; they are joined in text order. A text without any word gives ''.
    """
    prefix_words = len(config.prefix.split())
    budget = config.max_input_tokens - prefix_words
    if model is not None:
        prompted = df.withColumn("_in", F.concat(F.lit(config.prefix), cut_to_tokens(F.col(text_col), budget, cutter)))
        return run_model(prompted, model, "_in", out_col, ok_col, S.SUMMARY_FAILED).drop("_in")

    work = df.withColumn("_sents", tx.sentences(cut_to_tokens(F.col(text_col), budget, cutter)))
    # Every sentence has a word, so later ranks than this start at min_tokens or above.
    work = work.withColumn("_ranked", _ranked(F.col("_sents"), max(config.min_tokens, 1)))
    work = work.withColumn(
        "_kept",
        F.filter(
            "_ranked",
            lambda s, i: (i == 0)
            | (
                (_words_before(F.col("_ranked"), i) < config.min_tokens)
                & (_words_before(F.col("_ranked"), i) + s["n"] <= config.max_tokens)
            ),
        ),
    )
    in_text_order = F.sort_array(
        F.transform(
            "_kept",
            lambda s: F.struct(
                s["pos"],
                F.when(s["n"] > config.max_tokens, tx.first_tokens(s["text"], config.max_tokens))
                .otherwise(s["text"])
                .alias("text"),
            ),
        )
    )
    work = work.withColumns(
        {
            out_col: F.array_join(F.transform(in_text_order, lambda s: s["text"]), " "),
            ok_col: F.coalesce(F.size("_sents") > 0, F.lit(False)),
        }
    )
    return work.drop("_sents", "_ranked", "_kept")


def _words_before(ranked: Column, i: Column) -> Column:
    return F.aggregate(F.slice(ranked, F.lit(1), i), F.lit(0), lambda acc, s: acc + s["n"])
