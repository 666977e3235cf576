"""Requests, events, state and logs as the catalogue derives them from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators import frames, logs
from parchmill.operators.answer import answer
from parchmill.operators.summarize import summarize
from parchmill.session import configure, spread

# The test events are spread over a month, so the limiter gets a three-day window
# with which about one message in seven is refused.
WINDOW_US = 259_200 * 1_000_000


# Declared, so that planning does not have to open files to find the schema.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for operators that spend much time per text."""
    return spread(documents(spark, sf_dir))


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text submission."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
        "text",
        F.timestamp_seconds("doc_id").alias("ts"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question about the document of the same number."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(
        F.concat_ws("-", F.lit("q"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("conv_id").alias("doc_id"),
        F.col("text").alias("question"),
        F.timestamp_seconds("conv_id").alias("ts"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
        F.round(F.col("value") * 4000).cast("bigint").alias("latency_ms"),
    )


def bot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "ts_us",
        F.when(kind == "purchase", "file")
        .when(kind == "signup", "enter")
        .when(kind == "error", "exit")
        .otherwise("text")
        .alias("kind"),
        F.when(kind == "purchase", F.col("k")).alias("file_key"),
        "latency_ms",
        F.when(kind == "purchase", tx.content_hash(F.concat(F.lit("file-"), F.col("k").cast("string")))).alias(
            "content_sha"
        ),
    )


def asked_in_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the context that may be read, cut before it is shuffled."""
    contexts = documents(spark, sf_dir).withColumn("text", tx.truncate_context(F.col("text")))
    return frames.pair_questions(contexts, questions(spark, sf_dir), "doc_id")


def bot_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service makes of bot events (event_id, service, done_us, body, error): the summary of document
    k and the answer to the first question about it. Every tenth file and every tenth question is refused."""
    ev = events(spark, sf_dir).withColumn("done_us", F.col("ts_us") + F.col("latency_ms") * 1000)
    sent = ev.filter(F.col("event_type").isin("purchase", "view", "click"))
    is_file = F.col("event_type") == "purchase"
    wanted = sent.select(F.col("k").alias("doc_id")).distinct()
    texts = summarize(documents(spark, sf_dir).join(wanted, "doc_id", "left_semi"))
    summaries = sent.join(texts.select(F.col("doc_id").alias("k"), F.col("summary").alias("body")), "k", "left")
    first = asked_in_short(spark, sf_dir).join(wanted, "doc_id", "left_semi")
    turn = F.regexp_extract("request_id", r"(\d+)$", 1).cast("bigint")
    first = first.groupBy("doc_id").agg(F.min_by(F.struct("text", "question"), turn).alias("q")).select("doc_id", "q.*")
    answers = answer(first).select(F.col("doc_id").alias("k"), F.col("answer").alias("body"))
    asked = sent.filter(~is_file).join(answers, "k", "left")

    def rows(made: DataFrame, service: str, refused: Column) -> DataFrame:
        error = F.when(refused, F.lit(S.EXTRACT_FAILED))
        at = F.when(refused, F.col("ts_us")).otherwise(F.col("done_us"))
        return made.select("event_id", F.lit(service).alias("service"), at.alias("done_us"), "body", error.alias("error"))

    return rows(summaries, "summary", is_file & (F.col("k") % 10 == 7)).unionByName(
        rows(asked, "question", F.col("k") % 10 == 3)
    )


def web_result(event_id: Column) -> Column:
    """Stand-in result text of a web request."""
    return F.concat(F.lit("result "), event_id.cast("string"))


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    typed = F.when(k % 10 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("\t q"), k.cast("string"), F.lit(" \n")))
    named = (
        F.when(kind == "purchase", "upload").when(kind == "signup", "ask").when(kind == "error", "continue").otherwise("text")
    )
    return events(spark, sf_dir).select(
        "event_id", "user_id", "ts_us", named.alias("kind"), F.when(named == "text", typed).alias("text")
    )


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions and results; errors are dropped frames that never get a result."""
    ev = events(spark, sf_dir).withColumn(
        "request_id", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("k") % 20).cast("string"))
    )
    at = F.timestamp_micros(F.col("ts_us"))
    submitted = ev.withColumn("ts", at).transform(lambda d: d.select(
        "request_id",
        F.lit("processing").alias("value"),
        F.lit(0).alias("state_rank"),
        F.lit(True).alias("ok"),
        "ts",
    ))
    failed = F.col("event_type") == "signup"
    value = (
        F.when(failed, F.lit(S.SUMMARY_FAILED))
        .when(F.col("k") % 25 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("result "), F.col("event_id").cast("string")))
    )
    finished = ev.filter("event_type <> 'error'").select(
        "request_id",
        value.alias("value"),
        F.lit(1).alias("state_rank"),
        (~failed).alias("ok"),
        F.timestamp_micros(F.col("ts_us") + F.col("latency_ms") * 1000).alias("ts"),
    )
    return submitted.unionByName(finished)


def status_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four in five of these ids were never submitted."""
    return events(spark, sf_dir).select(
        "event_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("request_id"),
    )


def document_pages(spark: SparkSession, sf_dir: str, n_chars: int = 1000) -> DataFrame:
    """Documents cut to pages (doc_id, page_no, text)."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tx.chunks(F.col("text"), n_chars)).alias("page_no", "text"))


def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts; a system turn stands for an upload, and some model
    replies are missing. Which list a message is in and where a question is announced is made up."""
    turns = table(spark, sf_dir, "conversations")
    role, text = F.col("role"), F.col("text")
    size = F.length(text).cast("bigint")
    name = F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".txt"))
    info = F.when(role == "system", F.struct(name.alias("name"), size.alias("size"), F.lit("text/plain").alias("type")))
    before, after = S.WEB_UPLOADED.split("{}")
    return turns.select(
        "conv_id",
        "turn",
        F.when(role == "user", "user").when(role == "system", "file").otherwise("model").alias("type"),
        F.when(role == "system", F.concat(F.lit(before), name, F.lit(after)))
        .when((role == "assistant") & (size % 7 == 0), F.lit(None))
        .otherwise(text)
        .alias("text"),
        info.alias("file_info"),
        F.when((role != "system") & (F.col("turn") % 4 >= 2), "after").otherwise("main").alias("target"),
        ((role == "assistant") & (size % 5 == 0)).alias("asks"),
    )


def _log_line(us: Column, level: str, func_line: str, message: Column) -> Column:
    return F.concat(
        F.date_format(F.timestamp_micros(us), logs.TIME_FORMAT),
        F.lit(f" | {level:<8} | __main__:{func_line} - "),
        message,
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of events (event_id, value): views and clicks are summaries, signups are
    questions, errors are bad frames, purchases are broker failures."""
    ev = spread(events(spark, sf_dir)).withColumn("rid", F.md5(F.col("event_id").cast("string")))
    rid, k, kind = F.col("rid"), F.col("k").cast("string"), F.col("event_type")
    start, end = F.col("ts_us"), F.col("ts_us") + F.col("latency_ms") * 1000
    is_text = kind.isin("view", "click")
    first = (
        F.when(
            is_text,
            _log_line(start, "INFO", "main:11", F.concat(F.lit(logs.SUMMARY_START), rid, F.lit(", " + logs.TEXT_LENGTH), k)),
        )
        .when(
            kind == "signup",
            _log_line(
                start,
                "INFO",
                "main:13",
                F.concat(
                    F.lit(logs.QUESTION_START), rid, F.lit(", вопрос=q, "), k, F.lit("?, " + logs.CONTEXT_LENGTH), k
                ),
            ),
        )
        .when(kind == "error", _log_line(start, "ERROR", "main:15", F.concat(F.lit(logs.BAD_FRAME), k)))
        .otherwise(_log_line(start, "ERROR", "main:16", F.lit(logs.BROKER_DOWN + "NoBrokersAvailable")))
    )
    second = F.when(is_text, _log_line(end, "INFO", "main:12", F.concat(F.lit(logs.SUMMARY_END), rid))).when(
        kind == "signup", _log_line(end, "INFO", "main:14", F.concat(F.lit(logs.QUESTION_END), rid))
    )
    return ev.select("event_id", F.explode(F.array_compact(F.array(first, second))).alias("value"))


def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on the way to the answers in ``log_lines`` (event_id, file_path, value), a log per user. Every seventh
    question fails before its answer."""
    ev = events(spark, sf_dir).filter("event_type = 'signup'")
    k = F.col("k")
    text = {
        logs.QUESTION_TRANSLATION: F.concat(F.lit("q "), k.cast("string")),
        logs.QUESTION_TRANSLATED: F.concat(F.lit("q "), k.cast("string"), F.lit("?")),
        logs.CONTEXT_TRANSLATION: F.concat((k * 30).cast("string"), F.lit(" символов)")),
        logs.CONTEXT_TRANSLATED: F.concat((k * 31).cast("string"), F.lit(")")),
        logs.ANSWER_MADE: F.lit("a b"),
        logs.ANSWER_TRANSLATED: F.lit("c d"),
    }
    lines = []
    for i, (start, rest) in enumerate(text.items()):
        at = F.col("ts_us") + (k + 2) * i * i * 1000
        line = _log_line(at, "INFO", f"answer:{31 + i}", F.concat(F.lit(start), rest))
        lines.append(F.when(k % 7 != 0, line) if i > 3 else line)
    failed = F.concat(F.lit(logs.MESSAGE_FAILED), F.lit("no answer"))
    lines.append(F.when(k % 7 == 0, _log_line(F.col("ts_us") + (k + 2) * 16_000, "ERROR", "main:40", failed)))
    place = F.concat(F.lit("worker-"), F.col("user_id").cast("string"), F.lit(".log"))
    return ev.select("event_id", place.alias("file_path"), F.explode(F.array_compact(F.array(*lines))).alias("value"))


def gateway_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission lines (event_id, value) of the requests in ``log_lines``, some milliseconds earlier."""
    ev = events(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "signup"))
    sent_us = F.col("ts_us") - (F.col("k") + 1) * 7000
    asked = F.col("event_type") == "signup"

    def message(parts: tuple[str, str]) -> Column:
        name = F.concat(F.lit("ID=x "), F.col("k").cast("string"), F.lit(".txt"))
        return F.concat(F.lit(parts[0]), name, F.lit(parts[1]), F.md5(F.col("event_id").cast("string")))

    text = F.when(asked, message(logs.QUESTION_SENT)).otherwise(message(logs.FILE_SENT))
    return ev.select("event_id", _log_line(sent_us, "INFO", "intake:9", text).alias("value"))


# A small function-word lexicon for the word-by-word translator.
LEXICON = {
    "the": "этот", "and": "и", "of": "из", "in": "в", "is": "есть", "was": "был", "that": "что", "on": "на",
    "with": "с", "by": "от", "it": "оно", "for": "для", "are": "суть", "this": "это", "to": "к", "a": "один",
    "le": "этот", "la": "эта", "les": "эти", "un": "один", "une": "одна", "et": "и", "en": "в", "est": "есть",
    "que": "что", "qui": "кто", "pour": "для", "par": "через", "au": "к", "ou": "или", "der": "этот", "die": "эта",
    "das": "это", "und": "и", "ist": "есть", "nicht": "не", "ein": "один", "eine": "одна", "zu": "к", "von": "от",
    "el": "этот", "los": "эти", "y": "и", "es": "есть", "por": "через", "para": "для", "con": "с", "del": "из",
    "se": "себя", "su": "его",
}


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "src string, tgt string")


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of letters in a conversation as an entry: some thousand words."""
    turns = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return turns.select(F.explode(F.array_distinct(words)).alias("src")).distinct().withColumn(
        "tgt", F.concat(F.lit("<"), F.col("src"), F.lit(">"))
    )
