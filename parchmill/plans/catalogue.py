"""Named queries: every operator on the given tables. ``oracle`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import frames as frame
from parchmill.functions import text as tx
from parchmill.functions.decoding import decode_text as decoded
from parchmill.operators import extract, frames, limits, logs, polling, sessions, state
from parchmill.operators.answer import answer
from parchmill.operators.slices import find_slices
from parchmill.operators.summarize import summarize
from parchmill.operators.translate import IDENTITY, Translator, translate
from parchmill.plans import bot, inputs, service
from parchmill.session import cut_lineage, spread

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the text of their document."""
    return frames.pair_questions(inputs.documents(spark, sf_dir), inputs.questions(spark, sf_dir), "doc_id")


# --- frames ---------------------------------------------------------------------------


@query
def frame_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.summarize_frames(inputs.text_requests(spark, sf_dir), wire="delimited")
    return rows.select(
        F.col("key").alias("request_id"),
        "topic",
        F.sha2("value", 256).alias("frame_sha"),
        F.octet_length("value").cast("bigint").alias("n_bytes"),
    )


@query
def frame_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.question_frames(_asked(spark, sf_dir), wire="delimited")
    return rows.select(
        F.col("key").alias("request_id"),
        "topic",
        F.sha2("value", 256).alias("frame_sha"),
        F.octet_length("value").cast("bigint").alias("n_bytes"),
    )


@query
def json_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = frames.summarize_frames(inputs.text_requests(spark, sf_dir)).unionByName(
        frames.question_frames(_asked(spark, sf_dir))
    )
    back = frames.parse_frames(sent)
    return back.select(
        "topic", "request_id", _sha(F.col("text")).alias("text_sha"), _sha(F.col("question")).alias("question_sha")
    )


@query
def parse_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame has lost its delimiter."""
    requests = inputs.text_requests(spark, sf_dir)
    good = frame.encode_delimited(F.col("request_id"), F.col("text"))
    broken = F.translate("text", "|", " ").cast("binary")
    rows = requests.select(
        "doc_id",
        F.lit(S.TOPIC_SUMMARIZE).alias("topic"),
        F.when(F.col("doc_id") % 10 == 3, broken).otherwise(good).alias("value"),
        F.col("ts").alias("timestamp"),
    )
    return frames.parse_frames(rows, wire="delimited").select(
        "doc_id",
        "reason",
        "request_id",
        _sha(F.col("text")).alias("text_sha"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


def _question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited question frames; every fifth one has lost its question."""
    asked = _asked(spark, sf_dir)
    whole = frame.encode_delimited(F.col("request_id"), F.col("text"), F.col("question"))
    cut = frame.encode_delimited(F.col("request_id"), F.translate("text", "|", " "))
    return asked.select(
        F.lit(S.TOPIC_QUESTION).alias("topic"),
        F.col("request_id").alias("key"),
        F.when(F.col("doc_id") % 5 == 2, cut).otherwise(whole).alias("value"),
        F.col("ts").alias("timestamp"),
    )


@query
def parse_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = frames.parse_frames(_question_rows(spark, sf_dir), wire="delimited")
    return parsed.select(
        "key",
        "reason",
        "request_id",
        _sha(F.col("text")).alias("context_sha"),
        _sha(F.col("question")).alias("question_sha"),
    )


@query
def route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both topics as one stream of rows, routed by topic and validity."""
    summaries = frames.summarize_frames(inputs.text_requests(spark, sf_dir), wire="delimited")
    parsed = frames.parse_frames(summaries.unionByName(_question_rows(spark, sf_dir)), wire="delimited")
    return parsed.groupBy("topic", F.coalesce("reason", F.lit("ok")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("text_chars"),
        F.sum(F.coalesce(F.length("question"), F.lit(0)).cast("bigint")).alias("question_chars"),
    )


# --- files ----------------------------------------------------------------------------


def _utf8_pages(content: bytes) -> list[str]:
    """Page reader for the catalogue, whose files are plain text cut at form feeds."""
    return content.decode("utf-8").split("\f")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of five kinds; every seventh is an empty file."""
    kind = F.col("doc_id") % 5
    ext = F.when(kind == 0, ".TXT").when(kind == 1, ".pdf").when(kind == 2, ".docx").when(kind == 3, ".doc").otherwise("")
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("dir.x/f"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("content"),
    )


@query
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract.extract_text(_uploads(spark, sf_dir), pdf_reader=_utf8_pages, docx_reader=_utf8_pages)
    return texts.select(
        "doc_id", "filename", "ext", "accepted", "error", F.length("text").cast("bigint").alias("n_chars")
    )


@query
def file_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads taken in under ids of their own, summarized, and looked up by them."""
    files = _uploads(spark, sf_dir).select(
        F.col("filename").alias("path"),
        F.regexp_extract("filename", r"([^/]*)$", 1).alias("filename"),
        "content",
        F.timestamp_seconds("doc_id").alias("modified"),
    )
    taken = cut_lineage(service.take_in(files, pdf_reader=_utf8_pages, docx_reader=_utf8_pages))
    told = service.check_status(taken.select("request_id"), service.run([service.submit_taken(taken)]))
    refused = F.col("error").isNotNull()
    return taken.select("request_id", "path", "error").join(told, "request_id").select(
        "path",
        F.when(~refused, F.col("request_id")).alias("request_id"),
        "error",
        F.when(refused, "refused").otherwise(F.col("status")).alias("status"),
        "ok",
        _sha(F.col("summary")).alias("summary_sha"),
    )


@query
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents are stored in a one-byte encoding where their characters allow it."""
    docs = inputs.documents(spark, sf_dir)
    narrow = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x{00}-\x{FF}]")
    content = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    stored = docs.select("doc_id", content.alias("content"))
    return stored.select("doc_id", _sha(decoded(F.col("content"))).alias("text_sha"))


@query
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every fourth document are blank and come from OCR; others lack a page here
    and there."""
    pages = inputs.document_pages(spark, sf_dir)
    scanned = F.col("doc_id") % 4 == 0
    printed = pages.withColumn(
        "text", F.when(scanned | (F.col("page_no") % 5 == 3), F.lit(" \n")).otherwise(F.col("text"))
    )
    recognized = pages.withColumn("text", F.concat(F.lit("ocr:"), F.col("text")))
    texts = extract.with_ocr_fallback(printed, recognized, key="doc_id")
    return texts.select("doc_id", "by_ocr", _sha(F.col("text")).alias("text_sha"))


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir)
    pieces = docs.select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("pos", "chunk"))
    return pieces.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.length("chunk").cast("bigint").alias("n_chars"),
        _sha(F.col("chunk")).alias("chunk_sha"),
    )


# --- text -----------------------------------------------------------------------------


@query
def normalize_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with odd whitespace around; every third already ends in a mark."""
    turn = F.regexp_extract("request_id", r"(\d+)$", 1).cast("int")
    mark = F.when((F.col("doc_id") + turn) % 3 == 0, F.lit("?")).otherwise(F.lit(""))
    padded = F.concat(F.lit("\t  "), F.col("question"), mark, F.lit("  \r\n"))
    spaced = inputs.questions(spark, sf_dir).withColumn("question", padded)
    return frames.normalize_questions(spaced).select("request_id", "question")


@query
def qa_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = tx.question_prompt(tx.normalize_question(F.col("question")), tx.truncate_context(F.col("text")))
    return inputs.asked_in_short(spark, sf_dir).select(
        "request_id", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.length(prompt).cast("bigint").alias("n_chars")
    )


@query
def summarize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = summarize(inputs.spread_documents(spark, sf_dir))
    return done.select(
        "doc_id", "ok", _sha(F.col("summary")).alias("summary_sha"), F.length("summary").cast("bigint").alias("n_chars")
    )


@query
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = answer(inputs.asked_in_short(spark, sf_dir))
    return done.select(
        "request_id",
        "ok",
        F.col("score").cast("bigint").alias("score"),
        _sha(F.col("answer")).alias("answer_sha"),
        F.length("answer").cast("bigint").alias("n_chars"),
    )


@query
def translate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = translate(inputs.documents(spark, sf_dir), IDENTITY)
    return done.select(
        "doc_id", _sha(F.col("translation")).alias("text_sha"), F.length("translation").cast("bigint").alias("n_chars")
    )


@query
def translate_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Translator(lexicon=inputs.lexicon(spark))
    done = translate(inputs.spread_documents(spark, sf_dir), words)
    done = translate(done, words, out_col="unchunked", ok_col="ok2", chunk_chars=None)
    return done.select(
        "doc_id",
        _sha(F.col("translation")).alias("text_sha"),
        _sha(F.col("unchunked")).alias("unchunked_sha"),
    )


@query
def translate_lexicon_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``translate_lexicon`` with more entries than a plan can hold."""
    words = Translator(lexicon=inputs.large_lexicon(spark, sf_dir))
    done = translate(inputs.spread_documents(spark, sf_dir), words)
    return done.select("doc_id", _sha(F.col("translation")).alias("text_sha"))


# --- state and cache ------------------------------------------------------------------


@query
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = state.latest_state(inputs.state_log(spark, sf_dir))
    return latest.select("request_id", "value", "ok", F.unix_micros("ts").alias("ts_us"))


@query
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.look_up(inputs.status_requests(spark, sf_dir), inputs.state_log(spark, sf_dir)).select(
        "event_id", "request_id", "status", "summary", "ok"
    )


def _file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All file messages as if nothing were limited."""
    known = sessions.attach_results(inputs.bot_events(spark, sf_dir), inputs.bot_results(spark, sf_dir))
    return sessions.file_results(known.withColumn("limited", F.lit(False))).withColumns(
        {"summary": F.col("body"), "ok": F.lit(True)}
    )


@query
def cache_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = state.build_cache(_file_results(spark, sf_dir))
    return cache.select(tx.cache_key(F.col("content_sha")).alias("cache_key"), "ready_us", "summary")


@query
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = state.build_cache(_file_results(spark, sf_dir))
    files = inputs.bot_events(spark, sf_dir).filter("kind = 'file'")
    return state.probe_cache(files, cache).select(
        "event_id", "content_sha", "hit", F.when(F.col("hit"), F.col("summary")).alias("summary")
    )


@query
def dedup_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.compute_once(inputs.documents(spark, sf_dir), "text", summarize, ["summary", "ok"])
    return done.select("doc_id", "content_sha", "ok", _sha(F.col("summary")).alias("summary_sha"))


# --- limiter, sessions, polling -------------------------------------------------------


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = inputs.bot_events(spark, sf_dir).filter("kind in ('text', 'file')").select("event_id", "user_id", "ts_us")
    slices = find_slices(hits, "user_id", "ts_us")
    limited = limits.rate_limit(hits, inputs.WINDOW_US, slices=slices)
    return limited.select(
        "event_id", tx.rate_key(F.col("user_id")).alias("rate_key"), "window_start_us", "n_in_window", "limited"
    )


def _bot(spark: SparkSession, sf_dir: str) -> bot.BotRun:
    return bot.start(inputs.bot_events(spark, sf_dir), inputs.bot_results(spark, sf_dir), inputs.WINDOW_US)


@query
def bot_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = _bot(spark, sf_dir).routes()
    return routes.select(
        "event_id", "user_id", "route", F.when(F.col("route") == "question", F.col("last_file")).alias("about_file")
    )


@query
def last_file_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bot(spark, sf_dir).routes().select("event_id", "last_file")


@query
def bot_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bot.replies(_bot(spark, sf_dir).routes())
    return told.select("event_id", "route", "outcome", "observed_ms", "reply")


@query
def web_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.web_events(spark, sf_dir)
    routed = sessions.route_web(events, find_slices(events, "user_id", "ts_us"))
    return routed.select("event_id", "segment", "action", "route", "target", "user_text")


@query
def web_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events that lead to a request, with what the page shows. Some results are empty."""
    events = inputs.web_events(spark, sf_dir)
    routed = sessions.route_web(events, find_slices(events, "user_id", "ts_us"))
    waiting = routed.filter(F.col("route").isin("summarize_file", "summarize_text", "question"))
    latency = inputs.events(spark, sf_dir).select("event_id", "k", (F.col("latency_ms") % 60_000).alias("latency_ms"))
    seen = waiting.join(latency, "event_id")
    summary = F.when(F.col("k") % 9 != 0, inputs.web_result(F.col("event_id")))
    outcome, _ = polling.outcome(F.col("latency_ms"), S.WEB_POLL, has_text=summary.isNotNull())
    error = polling.web_error(outcome)
    return seen.select(
        "event_id", outcome.alias("outcome"), sessions.web_reply(summary, error, F.col("kind")).alias("shown")
    )


@query
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = inputs.transcript_messages(spark, sf_dir)
    numbered = sessions.transcript(messages, find_slices(messages, "conv_id", "turn"))
    return numbered.select(
        "conv_id",
        "turn",
        "target",
        "segment",
        "seq",
        "type",
        _sha(F.col("text")).alias("text_sha"),
        F.col("file_info.name").alias("file_name"),
        F.col("file_info.size").alias("file_size"),
    )


@query
def transcript_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = sessions.last_messages(inputs.transcript_messages(spark, sf_dir))
    return last.select("conv_id", "n_messages", "turn", "type", _sha(F.col("text")).alias("text_sha"))


@query
def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every event, and looks for ids nobody submitted (negative). Errors never get a result, some
    results are empty, some are written twice."""
    ev = inputs.events(spark, sf_dir)
    submitted = ev.select(F.col("event_id").alias("request_id"), "ts_us")
    unknown = ev.filter("k % 5 = 0").select((-F.col("event_id") - 1).alias("request_id"), "ts_us")
    value = F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(inputs.web_result(F.col("event_id")))
    finished = ev.filter("event_type <> 'error'").select(
        F.col("event_id").alias("request_id"),
        (F.col("ts_us") + F.col("latency_ms") * 1000).alias("done_us"),
        value.alias("value"),
        "k",
    )
    again = finished.filter("k % 10 = 0").withColumn("done_us", F.col("done_us") + 5_000_000)
    written = finished.unionByName(again).drop("k")
    clients = {"bot_summary": S.BOT_SUMMARY_POLL, "bot_answer": S.BOT_ANSWER_POLL, "web": S.WEB_POLL}
    return polling.poll_as(submitted.unionByName(unknown), written, clients, submitted).select(
        F.col("request_id").alias("event_id"), "client", "outcome", "observed_ms"
    )


# --- logs -----------------------------------------------------------------------------


def _log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.mark_requests(logs.parse_lines(inputs.log_lines(spark, sf_dir)))


@query
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(spark, sf_dir).select(
        "event_id",
        F.unix_millis("ts").alias("ts_ms"),
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"),
        "level",
        "module",
        "func",
        F.col("line").cast("bigint").alias("line"),
        "event",
        "request_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        _sha(F.col("message")).alias("message_sha"),
    )


@query
def log_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = logs.latencies(_log_rows(spark, sf_dir))
    return paired.select("request_id", "service", "latency_ms", F.col("n_chars").cast("bigint").alias("n_chars"))


@query
def log_queue_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.log_lines(spark, sf_dir).unionByName(inputs.gateway_lines(spark, sf_dir))
    return logs.queue_waits(logs.mark_requests(logs.parse_lines(lines)))


@query
def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latency_stats(logs.latencies(_log_rows(spark, sf_dir)))


@query
def log_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the stages of answering take, and the questions that fail on the way."""
    rows = logs.mark_requests(logs.parse_lines(inputs.stage_lines(spark, sf_dir)))
    failed = rows.filter("event = 'message_failed'").agg(
        F.lit("failed").alias("stage"), F.count(F.lit(1)).alias("n_stages"), *(F.lit(None).cast("bigint").alias(c) for c in ("total_ms", "min_ms", "max_ms"))
    )
    return logs.stage_stats(logs.stage_times(rows)).unionByName(failed)


@query
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.level_counts(logs.parse_lines(inputs.log_lines(spark, sf_dir)))


# --- the whole service ----------------------------------------------------------------


@query
def request_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and questions submitted, framed, parsed, worked off and looked up, with
    an id that was never submitted for every document."""
    texts = spread(inputs.text_requests(spark, sf_dir))
    asked = inputs.asked_in_short(spark, sf_dir)
    submitted = [
        service.submit_texts(texts),
        service.Submission(frames.processing_rows(asked), frames.question_frames(asked)),
    ]
    wanted = texts.select("request_id", F.concat(F.lit("x"), F.col("request_id")).alias("absent"))
    wanted = wanted.select(F.explode(F.array("request_id", "absent")).alias("request_id"))
    wanted = wanted.unionByName(inputs.questions(spark, sf_dir).select("request_id"))
    told = service.check_status(wanted, service.run(submitted))
    return told.select("request_id", "status", "ok", _sha(F.col("summary")).alias("summary_sha"))
