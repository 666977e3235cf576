"""Requests to topic rows, and topic rows back to requests or dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import frames as frame
from parchmill.functions import text as tx
from parchmill.operators.joins import join_salted

FORMATS = ("json", "delimited")


def with_request_id(df: DataFrame) -> DataFrame:
    """Give every row a random id. Persist the result before using it twice: ``uuid`` is
    drawn anew whenever the plan runs again."""
    return df.withColumn("request_id", F.expr("uuid()"))


def summarize_frames(requests: DataFrame, wire: str = "json") -> DataFrame:
    """(request_id, text, ts) -> topic rows of the summarize topic."""
    rid, text = F.col("request_id"), F.col("text")
    value = frame.encode_json(rid, text) if wire == "json" else frame.encode_delimited(rid, text)
    return _topic_rows(requests, S.TOPIC_SUMMARIZE, value)


def question_frames(requests: DataFrame, wire: str = "json") -> DataFrame:
    """(request_id, text, question, ts) -> topic rows of the question topic."""
    rid, text, question = F.col("request_id"), F.col("text"), F.col("question")
    value = (
        frame.encode_json(rid, text, question) if wire == "json" else frame.encode_delimited(rid, text, question)
    )
    return _topic_rows(requests, S.TOPIC_QUESTION, value)


def _topic_rows(requests: DataFrame, topic: str, value: Column) -> DataFrame:
    return requests.select(
        F.lit(topic).alias("topic"), F.col("request_id").alias("key"), value.alias("value"), F.col("ts").alias("timestamp")
    )


def processing_rows(requests: DataFrame) -> DataFrame:
    """The state rows that mark accepted requests, written before their frames."""
    return requests.select(
        "request_id",
        F.lit("processing").alias("value"),
        F.lit(0).alias("state_rank"),
        F.lit(True).alias("ok"),
        "ts",
    )


def parse_frames(rows: DataFrame, wire: str = "json") -> DataFrame:
    """Topic rows -> one row each with request_id, text, question (NULL on the summarize
    topic) and ``reason``, which is NULL for a good frame.

    A bad value never fails the job: the decode is guarded by a UTF-8 check, and
    whatever cannot be split into its parts keeps only its reason.
    """
    text_value = F.col("value").cast("string")
    readable = F.is_valid_utf8(text_value)
    is_question = F.col("topic") == S.TOPIC_QUESTION
    known = F.col("topic").isin(S.TOPIC_SUMMARIZE, S.TOPIC_QUESTION)
    if wire == "json":
        parsed = rows.withColumn("_body", F.when(readable & known, frame.decode_json(text_value)))
        body = F.col("_body")
        complete = body["request_id"].isNotNull() & body["text"].isNotNull()
        complete = complete & (~is_question | body["question"].isNotNull())
        rid, text, question = body["request_id"], body["text"], body["question"]
    else:
        parts = F.when(is_question, frame.split_delimited(text_value, 3)).otherwise(
            frame.split_delimited(text_value, 2)
        )
        parsed = rows.withColumn("_body", F.when(readable & known, parts))
        body = F.col("_body")
        complete = F.size(body) == F.when(is_question, F.lit(3)).otherwise(F.lit(2))
        rid, text, question = F.get(body, 0), F.get(body, 1), F.get(body, 2)
    complete = F.coalesce(complete, F.lit(False))
    reason = (
        F.when(~known, F.lit("unknown topic"))
        .when(~readable, F.lit("not UTF-8"))
        .when(~complete, F.lit("malformed frame"))
    )
    fields = {
        "reason": reason,
        "request_id": F.when(complete, rid),
        "text": F.when(complete, text),
        "question": F.when(complete & is_question, question),
    }
    return tx.computed(parsed, fields).drop("_body")


def good_frames(parsed: DataFrame, topic: str) -> DataFrame:
    return parsed.filter((F.col("topic") == topic) & F.col("reason").isNull())


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select(
        "topic", "value", "reason", F.col("timestamp").alias("ts")
    )


def pair_questions(files: DataFrame, questions: DataFrame, on: str) -> DataFrame:
    """File texts with the questions asked about them.

    Texts are unique per file, questions are not; a much-asked file is salted.
    """
    return join_salted(questions, files, on)


def normalize_questions(df: DataFrame, column: str = "question") -> DataFrame:
    return df.withColumn(column, tx.normalize_question(F.col(column)))
