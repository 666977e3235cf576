"""Per-user session logic as running values: bot routing, web routing, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators import polling
from parchmill.operators.limits import WINDOW_US, rate_limit
from parchmill.operators.slices import Running, Slices, add_running
from parchmill.operators.state import build_cache, probe_cache

# Total order of a user's rows; a completion comes before a message of the same instant.
BOT_ORDER = ("ts_us", "rank", "event_id")
WEB_ORDER = ("ts_us", "event_id")
# Marks a forgotten file, where NULL would mean "no news".
NO_FILE = -1
# How long the bot waits for a service, and which service a route waits for.
SERVICES = {"summary": S.BOT_SUMMARY_POLL, "question": S.BOT_ANSWER_POLL}
WAITING = {"summarize_text": "summary", "summarize_file": "summary", "question": "question"}
# What is known of an event's results, where there are any.
RESULT_COLUMNS = ("body", "error", "answer", "answer_ms", "answer_error")


def attach_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events with the results of the service: latency_ms, body, error of its summary, and answer_ms,
    answer, answer_error.

    ``results``: event_id, service (``summary`` or ``question``), done_us, body, error. A row with an
    ``error`` is a refused upload. Of several results the earliest counts. An empty result is never seen.
    """
    content = F.struct("done_us", "body", "error")
    place = F.struct("done_us", F.col("error").isNull(), "body")
    wide = results.groupBy("event_id").agg(
        *(F.min_by(content, F.when(F.col("service") == name, place)).alias(name) for name in SERVICES)
    )
    met = events.drop("latency_ms", *RESULT_COLUMNS).join(wide, "event_id", "left")

    def latency(name: str) -> Column:
        there = F.col(f"{name}.error").isNull() & (F.col(f"{name}.body") != "")
        waited = F.greatest(F.col(f"{name}.done_us") - F.col("ts_us"), F.lit(0).cast("bigint"))
        return F.when(there, F.call_function("div", waited + 999, F.lit(1000)))

    return met.withColumns(
        {
            "latency_ms": latency("summary"),
            "body": F.col("summary.body"),
            "error": F.col("summary.error"),
            "answer_ms": latency("question"),
            "answer": F.col("question.body"),
            "answer_error": F.col("question.error"),
        }
    ).drop(*SERVICES)


def file_results(limited: DataFrame) -> DataFrame:
    """Results of the file messages that were let through and came back in time, as the
    bot saw them: (content_sha, summary, done_us, event_id, ok, ...)."""
    state, observed = polling.outcome(F.col("latency_ms"), S.BOT_SUMMARY_POLL)
    files = limited.filter((F.col("kind") == "file") & ~F.col("limited"))
    return files.filter(state == "done").withColumn("done_us", F.col("ts_us") + observed * 1000)


def count_messages(
    events: DataFrame, window_us: int = WINDOW_US, limit: int = S.RATE_LIMIT, slices: Slices | None = None
) -> DataFrame:
    """The texts and files among the bot events, with their limiter verdict.

    Buttons (enter, exit) are not counted. ``events``: event_id, user_id, ts_us, kind,
    file_key, latency_ms, content_sha.
    """
    return rate_limit(events.filter(F.col("kind").isin("text", "file")), window_us, limit, slices=slices)


def add_cache_hits(counted: DataFrame, summary: Column) -> DataFrame:
    """Add ``hit`` to counted messages. A hit needs a result that was ready before, so
    only the earliest result per content matters."""
    cache = build_cache(file_results(counted).withColumns({"summary": summary, "ok": F.lit(True)}))
    asking = (F.col("kind") == "file") & ~F.col("limited")
    # Only let-through files look into the cache; nothing else needs the shuffle by content.
    probed = probe_cache(counted.filter(asking), cache.withColumnRenamed("summary", "cached"))
    probed = probed.withColumn("cached", F.when(F.col("hit"), F.col("cached"))).drop("ready_us")
    others = counted.filter(~asking).withColumns({"hit": F.lit(False), "cached": F.lit(None).cast("string")})
    return probed.unionByName(others)


def completions(messages: DataFrame) -> DataFrame:
    """One row per file summary delivered, at the time of delivery."""
    fresh = messages.filter(~F.col("hit"))
    return file_results(fresh).select(
        "event_id", "user_id", F.col("done_us").alias("ts_us"), F.lit("done").alias("kind"), "file_key"
    )


def route_bot(messages: DataFrame, buttons: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Routes of all bot events.

    ``messages``: texts and files with ``limited`` and ``hit``; ``buttons``: enter and
    exit events. Every message sees the question mode and the last file as left by
    the rows before it; a last file appears when its summary is delivered, not when
    the file is sent.
    """
    carried = ["event_id", "user_id", "ts_us", "kind", "file_key", "latency_ms", "limited", "hit", "cached"]
    carried += [c for c in RESULT_COLUMNS if c in messages.columns]
    unmarked = {"limited": F.lit(False), "hit": F.lit(False)}
    presses = buttons.select("event_id", "user_id", "ts_us", "kind").withColumns(unmarked)
    delivered = completions(messages).withColumns(unmarked)
    rows = (
        messages.select(*carried)
        .unionByName(presses, allowMissingColumns=True)
        .unionByName(delivered, allowMissingColumns=True)
        .withColumn("rank", F.when(F.col("kind") == "done", 0).otherwise(1))
    )
    kind, passed = F.col("kind"), ~F.col("limited") & ~F.col("hit")
    mode = F.when(kind == "enter", 1).when((kind == "exit") | ((kind == "file") & passed), 0)
    last = F.when(kind == "done", F.col("file_key")).when(kind == "exit", F.lit(NO_FILE).cast("bigint"))
    state = add_running(
        rows, ["user_id"], BOT_ORDER, {"mode": Running("last", mode), "held": Running("last", last)}, slices
    )
    asking = F.coalesce(F.col("mode") == 1, F.lit(False))
    held = F.when(F.col("held") != NO_FILE, F.col("held"))
    route = (
        F.when(kind.isin("enter", "exit"), kind)
        .when(F.col("limited"), F.lit("rate_limited"))
        .when(F.col("hit"), F.lit("cache_hit"))
        .when(kind == "file", F.lit("summarize_file"))
        .when(asking & held.isNull(), F.lit("qa_no_file"))
        .when(asking, F.lit("question"))
        .otherwise(F.lit("summarize_text"))
    )
    return (
        state.filter(kind != "done")
        .withColumns({"route": route, "last_file": held})
        .drop("rank", "mode", "held")
    )


def reply_text(route: Column, outcome: Column, body: Column, error: Column | None = None) -> Column:
    """The message the user gets for a routed event."""
    failed = F.lit(False) if error is None else error.isNotNull()
    message = F.lit("") if error is None else error
    return (
        F.when(route == "rate_limited", F.lit(S.REPLY_LIMITED))
        .when(route == "qa_no_file", F.lit(S.REPLY_NO_FILE))
        .when(route == "cache_hit", F.concat(F.lit(S.REPLY_CACHED), body))
        .when(route == "enter", F.lit(S.REPLY_ENTER))
        .when(route == "exit", F.lit(S.REPLY_EXIT))
        .when(failed, F.concat(F.lit(S.REPLY_ERROR), message))
        .when((route == "question") & (outcome == "done"), F.concat(F.lit(S.REPLY_ANSWER), body))
        .when(route == "question", F.lit(S.REPLY_ANSWER_TIMEOUT))
        .when(outcome == "done", F.concat(F.lit(S.REPLY_DONE), body))
        .otherwise(F.lit(S.REPLY_SUMMARY_TIMEOUT))
    )


def route_web(events: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Routes of web events (event_id, user_id, ts_us, kind, text).

    An upload opens a segment. In a segment the first continue or ask decides the
    action, and later ones do nothing. ``target`` says which message list a row
    belongs to: the one before or the one after the action.
    """
    kind = F.col("kind")
    own = F.struct("ts_us", "event_id")
    seen = add_running(
        events, ["user_id"], WEB_ORDER, {"upload": Running("last", F.when(kind == "upload", own))}, slices
    )
    # Uploads start their own segment; rows before any upload share the NULL segment.
    seen = seen.withColumn("segment", F.when(kind == "upload", F.col("event_id")).otherwise(F.col("upload.event_id")))
    choice = F.when(
        kind.isin("continue", "ask") & F.col("segment").isNotNull(), F.struct("ts_us", "event_id", "kind")
    )
    state = add_running(
        seen, ["user_id", "segment"], WEB_ORDER, {"chosen": Running("min", choice)}, slices
    )
    action = F.when(F.col("chosen.kind") == "ask", F.lit("question")).otherwise(F.col("chosen.kind"))
    free = F.col("segment").isNotNull() & action.isNull()
    user_text = tx.strip(F.col("text"))
    route = (
        F.when(kind == "upload", F.lit("summarize_file"))
        .when((kind == "continue") & free, F.lit("summarize_file"))
        .when((kind == "ask") & free, F.lit("prompt"))
        .when(kind.isin("continue", "ask"), F.lit("ignored"))
        .when(user_text == "", F.lit("ignored"))
        .when(action == "question", F.lit("question"))
        .otherwise(F.lit("summarize_text"))
    )
    return state.withColumns(
        {
            "route": route,
            "action": action,
            "user_text": F.when(kind == "text", user_text),
            "target": F.when((kind == "text") & action.isNotNull(), F.lit("after"))
            .when(kind == "continue", F.lit("after"))
            .otherwise(F.lit("main")),
        }
    ).drop("upload", "chosen")


def web_reply(summary: Column, poll_error: Column, kind: Column) -> Column:
    """What the web client shows: a poll error gives the generic text of the action, a
    missing summary (also when the service returned an error) the fixed one."""
    generic = (
        F.when(kind == "upload", F.lit(S.WEB_FILE_FAILED))
        .when(kind == "continue", F.lit(S.WEB_CONTINUE_FAILED))
        .otherwise(F.lit(S.WEB_REQUEST_FAILED))
    )
    present = summary.isNotNull() & (summary != "")
    return F.when(poll_error.isNotNull(), generic).when(present, summary).otherwise(F.lit(S.WEB_NO_SUMMARY))


def _shown(messages: DataFrame) -> Column:
    """The text of a message; a model message without one shows the fixed text."""
    missing = (F.col("type") == "model") & (F.coalesce(F.col("text"), F.lit("")) == "")
    return F.when(missing, F.lit(S.WEB_NO_SUMMARY)).otherwise(F.col("text"))


def transcript(messages: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Numbered messages of the page's two lists, ``main`` and ``after``.

    ``messages``: conv_id, turn, type, text, file_info, target (the list) and asks (a question
    was announced here). The main list numbers on for ever (segment 0). A file and an
    announced question empty the other list: it starts a new segment.
    """
    empties = F.coalesce((F.col("type") == "file") | F.col("asks"), F.lit(False)).cast("bigint")
    opened = add_running(messages, ["conv_id"], ["turn"], {"emptied": Running("sum", empties)}, slices)
    after = F.col("target") == "after"
    segmented = opened.withColumn("segment", F.when(after, F.col("emptied") + empties).otherwise(F.lit(0).cast("bigint")))
    numbered = add_running(
        segmented,
        ["conv_id", "target", "segment"],
        ["turn"],
        {"before": Running("sum", F.lit(1).cast("bigint"))},
        slices,
    )
    return numbered.withColumns({"seq": F.col("before") + 1, "text": _shown(messages)}).drop("emptied", "before")


def last_messages(messages: DataFrame) -> DataFrame:
    """The newest message of every conversation as it is shown, combined before the shuffle."""
    newest = F.max_by(F.struct("turn", "type", _shown(messages).alias("text")), "turn").alias("m")
    return messages.groupBy("conv_id").agg(newest, F.count(F.lit(1)).alias("n_messages")).select(
        "conv_id", "n_messages", "m.turn", "m.type", "m.text"
    )
