from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import sessions
from parchmill.operators.slices import find_slices
from parchmill.plans import bot, inputs

MS = 1000


def bot_model(events, window_us, limit=5):
    """The bot, event by event: limiter, cache, question mode, last file."""
    todo = sorted([(e["ts_us"], 1, e["event_id"], e) for e in events], key=lambda x: x[:3])
    opened, cache, mode, last = {}, {}, {}, {}
    done, out = [], {}
    while todo:
        todo.sort(key=lambda x: x[:3])
        ts, rank, eid, e = todo.pop(0)
        user = e["user_id"]
        if rank == 0:
            if e["file_key"] not in cache or cache[e["file_key"]] > ts:
                cache[e["file_key"]] = ts
            last[user] = e["file_key"]
            continue
        held = last.get(user)
        kind = e["kind"]
        if kind == "enter":
            mode[user], route = True, "enter"
        elif kind == "exit":
            mode.pop(user, None)
            last.pop(user, None)
            route = "exit"
        else:
            start, n = opened.get(user, (None, 0))
            if start is None or ts >= start + window_us:
                start, n = ts, 0
            opened[user] = (start, n + 1)
            if n + 1 > limit:
                route = "rate_limited"
            elif kind == "file" and cache.get(e["file_key"], ts + 1) <= ts:
                route = "cache_hit"
            elif kind == "file":
                route = "summarize_file"
                mode.pop(user, None)
                if not e.get("error") and e["latency_ms"] <= 240_000:
                    seen = 2_000_000 * max(1, -(-e["latency_ms"] // 2000))
                    todo.append((ts + seen, 0, eid, e))
            elif mode.get(user):
                route = "question" if held is not None else "qa_no_file"
            else:
                route = "summarize_text"
        out[eid] = (route, held)
    return out


def bot_events(n, seed):
    rng = random.Random(seed)
    times = rng.sample(range(4000), n)
    kinds = ["text", "file", "enter", "exit"]
    return [
        {
            "event_id": i,
            "user_id": rng.choice([1, 1, 1, 2, 3]),
            "ts_us": times[i] * 1_000_000 + 1,
            "kind": rng.choices(kinds, [4, 4, 3, 1])[0],
            "file_key": rng.randrange(12),
            "latency_ms": rng.randrange(300_000),
        }
        for i in range(n)
    ]


def frame(spark, events):
    df = spark.createDataFrame(
        [tuple(e.values())[:6] for e in events],
        "event_id bigint, user_id bigint, ts_us bigint, kind string, file_key bigint, latency_ms bigint",
    )
    return df.withColumn("content_sha", F.when(F.col("kind") == "file", F.sha2(F.col("file_key").cast("string"), 256)))


def results_of(spark, events):
    """(event_id, service, done_us, body, error) of made-up events; an answer takes as long as a summary."""
    rows = []
    for e in events:
        done = e["ts_us"] + e["latency_ms"] * MS
        if e["kind"] == "file" and e.get("error"):
            rows.append((e["event_id"], "summary", e["ts_us"], None, e["error"]))
        elif e["kind"] in ("text", "file"):
            body = f"file {e['file_key']}" if e["kind"] == "file" else f"text {e['event_id']}"
            rows += [(e["event_id"], "summary", done, body, None), (e["event_id"], "summary", done + 5, "again", None)]
        if e["kind"] == "text" and e.get("error"):
            rows.append((e["event_id"], "question", e["ts_us"], None, e["error"]))
        elif e["kind"] == "text":
            rows.append((e["event_id"], "question", done, f"answer {e['event_id']}", None))
    return spark.createDataFrame(rows, "event_id bigint, service string, done_us bigint, body string, error string")


@pytest.mark.parametrize("seed,hot_rows", [(1, 10_000), (2, 10_000), (3, 40)])
def test_bot_routes_equal_the_sequential_bot(spark, seed, hot_rows):
    events = [e | {"error": "broken" if e["event_id"] % 11 == 0 else None} for e in bot_events(500, seed)]
    window = 120_000_000
    run = bot.start(frame(spark, events), results_of(spark, events), window, hot_rows=hot_rows)
    assert run.slices.any_hot == (hot_rows < 100)
    got = {r.event_id: (r.route, r.last_file) for r in run.routes().collect()}
    want = bot_model(events, window)
    assert set(r for r, _ in want.values()) >= {"question", "qa_no_file", "cache_hit", "rate_limited"}
    assert got == want
    told = {r.event_id: (r.outcome, r.observed_ms, r.reply) for r in bot.replies(run.routes()).collect()}
    by_id = {e["event_id"]: e for e in events}
    for event_id, (route, _) in want.items():
        e = by_id[event_id]
        looks = 2000 * max(1, -(-e["latency_ms"] // 2000))
        if e["error"] and route in ("summarize_file", "question"):
            assert told[event_id] == ("error", 0, S.REPLY_ERROR + "broken")
        elif route == "question":
            done = e["latency_ms"] <= 120_000
            reply = f"{S.REPLY_ANSWER}answer {event_id}" if done else S.REPLY_ANSWER_TIMEOUT
            assert told[event_id] == ("done" if done else "timeout", looks if done else 120_000, reply)
        elif route == "summarize_file" and e["latency_ms"] <= 240_000:
            assert told[event_id] == ("done", looks, f"{S.REPLY_DONE}file {e['file_key']}")
        elif route == "cache_hit":
            assert told[event_id] == (None, None, f"{S.REPLY_CACHED}file {e['file_key']}")


def web_model(events):
    state, out = {}, {}
    for eid, user, ts, kind, text in sorted(events, key=lambda e: (e[2], e[0])):
        segment, action = state.get(user, (None, None))
        if kind == "upload":
            segment, action = eid, None
            out[eid] = (segment, None, "summarize_file")
        elif kind in ("continue", "ask"):
            if segment is None or action:
                out[eid] = (segment, action, "ignored")
            else:
                out[eid] = (segment, None, "summarize_file" if kind == "continue" else "prompt")
                action = "continue" if kind == "continue" else "question"
        elif not text.strip():
            out[eid] = (segment, action, "ignored")
        else:
            out[eid] = (segment, action, "question" if action == "question" else "summarize_text")
        state[user] = (segment, action)
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_web_routes_equal_the_sequential_page(spark, hot_rows):
    rng = random.Random(7)
    events = [
        (i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(100_000), rng.choice(["text", "text", "upload", "continue", "ask"]), rng.choice(["a", " \t"]))
        for i in range(1200)
    ]
    df = spark.createDataFrame(events, "event_id bigint, user_id bigint, ts_us bigint, kind string, text string")
    slices = find_slices(df, "user_id", "ts_us", hot_rows)
    assert slices.any_hot == (hot_rows < 100)
    got = {r.event_id: (r.segment, r.action, r.route) for r in sessions.route_web(df, slices).collect()}
    assert got == web_model(events)


def test_transcript_is_the_same_when_a_conversation_is_cut(spark, sf_dir):
    messages = inputs.transcript_messages(spark, sf_dir).withColumn("conv_id", F.col("conv_id") % 3)
    messages = messages.withColumn("turn", F.xxhash64("turn", "text") % 1000).dropDuplicates(["conv_id", "turn"])
    plain = sessions.transcript(messages)
    cut = find_slices(messages, "conv_id", "turn", hot_rows=5)
    assert cut.any_hot
    names = ["conv_id", "turn", "target", "segment", "seq", "type", "text"]
    assert sorted(sessions.transcript(messages, cut).select(*names).collect()) == sorted(plain.select(*names).collect())


def test_only_the_second_list_restarts(spark):
    rows = [
        (1, "user", "main", False), (2, "file", "main", False), (3, "model", "after", False), (4, "user", "after", False),
        (5, "model", "main", True), (6, "user", "after", False), (7, "file", "main", None), (8, "model", "after", False),
    ]
    df = spark.createDataFrame([(9, turn, kind, None, target, asks) for turn, kind, target, asks in rows],
                               "conv_id long, turn long, type string, text string, target string, asks boolean")
    got = {r.turn: (r.target, r.segment, r.seq) for r in sessions.transcript(df).collect()}
    assert [got[t] for t in (1, 2, 5, 7)] == [("main", 0, n) for n in (1, 2, 3, 4)]
    assert [got[t] for t in (3, 4, 6, 8)] == [("after", 1, 1), ("after", 1, 2), ("after", 2, 1), ("after", 3, 1)]


def test_replies(spark):
    rows = [
        ("rate_limited", None, None),
        ("qa_no_file", None, None),
        ("cache_hit", None, None),
        ("question", "done", None),
        ("question", "timeout", None),
        ("summarize_file", "done", None),
        ("summarize_text", "timeout", None),
        ("summarize_file", None, "broken"),
    ]
    df = spark.createDataFrame(rows, "route string, outcome string, error string")
    got = [r[0] for r in df.select(sessions.reply_text(F.col("route"), F.col("outcome"), F.lit("B"), F.col("error"))).collect()]
    assert got == [
        S.REPLY_LIMITED,
        S.REPLY_NO_FILE,
        S.REPLY_CACHED + "B",
        S.REPLY_ANSWER + "B",
        S.REPLY_ANSWER_TIMEOUT,
        S.REPLY_DONE + "B",
        S.REPLY_SUMMARY_TIMEOUT,
        S.REPLY_ERROR + "broken",
    ]
