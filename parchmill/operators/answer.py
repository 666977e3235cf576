"""Answers to questions about a text, map-only like the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators.backends import CutterFactory, ModelFactory, cut_to_tokens, run_model
from parchmill.operators.translate import Translator, translate


def answer(
    df: DataFrame,
    context_col: str = "text",
    question_col: str = "question",
    out_col: str = "answer",
    ok_col: str = "ok",
    config: S.GenerationConfig = S.ANSWER,
    model: ModelFactory | None = None,
    to_model: Translator | None = None,
    from_model: Translator | None = None,
    cutter: CutterFactory | None = None,
) -> DataFrame:
    """Add an answer, its score (number of question words found) and an ok flag.

    The question is normalized and the context cut before any costly step. With
    translators, question and context are translated on the way in and the answer
    on the way out; the fixed not-found text is not translated. ``cutter`` counts the tokens
    of a model's input.
    """
    work = df.withColumns(
        {
            "_q": tx.normalize_question(F.col(question_col)),
            "_c": tx.truncate_context(F.col(context_col)),
        }
    )
    if to_model is not None:
        work = translate(work, to_model, "_q", "_q", "_q_ok")
        work = translate(work, to_model, "_c", "_c", "_c_ok").drop("_q_ok", "_c_ok")
    if model is None:
        work = _extract(work, config)
    else:
        work = work.withColumn("_in", cut_to_tokens(tx.question_prompt(F.col("_q"), F.col("_c")), config.max_input_tokens, cutter))
        work = run_model(work, model, "_in", "_a", "_model_ok", S.ANSWER_FAILED).drop("_in")
        work = work.withColumn("_score", F.lit(None).cast("int"))
    found = F.coalesce(F.length("_a") >= S.MIN_ANSWER_CHARS, F.lit(False))
    work = work.withColumns({"_found": found, ok_col: found & F.col("_model_ok")})
    if from_model is not None:
        # The fixed text of a failed model stays as it is and does not reach the translator.
        failed = ~F.coalesce(F.col("_model_ok"), F.lit(False))
        work = work.withColumns({"_raw": F.col("_a"), "_a": F.when(failed, F.lit("")).otherwise(F.col("_a"))})
        work = translate(work, from_model, "_a", "_a", "_a_ok", chunk_chars=None).drop("_a_ok")
        work = work.withColumn("_a", F.when(failed, F.col("_raw")).otherwise(F.col("_a"))).drop("_raw")
    return work.withColumns(
        {
            out_col: F.when(F.col("_found"), F.col("_a")).otherwise(F.lit(S.ANSWER_NOT_FOUND)),
            "score": F.col("_score"),
        }
    ).drop("_q", "_c", "_a", "_score", "_model_ok", "_found")


def _extract(work: DataFrame, config: S.GenerationConfig) -> DataFrame:
    """Best sentence by distinct question words, followed by the next ones up to the length bounds."""
    work = work.withColumn("_sents", tx.sentences(F.col("_c")))
    # The greatest (score, -position) is the first sentence of the best score.
    work = work.withColumn(
        "_best",
        tx.let(
            tx.tokens(F.col("_q")),
            lambda asked: F.array_max(
                F.transform(
                    "_sents",
                    lambda s, i: F.struct(
                        F.size(F.array_intersect(s["words"], asked)).alias("score"), (-i).alias("neg_pos")
                    ),
                )
            ),
        ),
    )
    # Every sentence has a word: at most min_tokens of them start below that bound.
    tail = F.slice("_sents", F.lit(1) - F.col("_best.neg_pos"), F.lit(max(config.min_tokens, 1)))
    work = work.withColumn("_tail", F.when(F.col("_best.score") > 0, tail))
    kept = F.filter(
        "_tail",
        lambda s, i: F.aggregate(
            F.slice(F.col("_tail"), F.lit(1), i), F.lit(0), lambda acc, x: acc + F.size(x["words"])
        )
        < config.min_tokens,
    )
    return work.withColumns(
        {
            "_a": tx.first_tokens(F.array_join(F.transform(kept, lambda s: s["text"]), " "), config.max_tokens),
            "_score": F.coalesce(F.col("_best.score"), F.lit(0)),
            "_model_ok": F.lit(True),
        }
    ).drop("_sents", "_best", "_tail")
