"""Keyed streams on rows that come out of order, against the batch form on all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import polling, sessions
from parchmill.operators.limits import rate_limit
from parchmill.operators.state import build_cache, probe_cache
from parchmill.plans import bot, inputs
from parchmill.streaming import bot as bot_streams
from parchmill.streaming import cache as cache_streams
from parchmill.streaming import limiter
from parchmill.streaming import polling as poll_streams
from parchmill.streaming import sessions as session_streams
from tests.test_sessions import bot_events, frame, results_of
from tests.test_streaming import collect, stream_of

SECOND = 1_000_000
DELAY_S = 40
DELAY = f"{DELAY_S} seconds"


def shuffled(rows, seed):
    """Rows in an order in which none comes ``DELAY_S`` behind a later one; ``at`` is when it comes."""
    rng = random.Random(seed)
    came = [r | {"at": r["ts_us"] + rng.uniform(-0.45, 0.45) * DELAY_S * SECOND} for r in rows]
    return sorted(came, key=lambda r: r["at"])


def write_files(spark, folder, rows, schema, n=4, span=1000 * SECOND):
    """Dicts as files, one per micro-batch: what comes in each n-th of the span, and the rest in the last one."""
    names = [part.split()[0] for part in schema.split(", ")]
    place = lambda r: min(n - 1, max(0, int(r["at"] * n / span))) if "at" in r else n - 1
    for i in range(n):
        part = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows if place(r) == i], schema)
        part.withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return stream_of(spark, str(folder), schema + ", ts timestamp")


def differences(one, other, names):
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()), key=repr)
    a, b = rows(one), rows(other)
    return [] if a == b else [len(a), len(b), [x for x in a if x not in b][:5], [x for x in b if x not in a][:5]]


HITS = "event_id bigint, user_id bigint, ts_us bigint"


def hits(n, seed, users=(1, 1, 2, 3, None)):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(900), n))
    return [{"event_id": i, "user_id": rng.choice(users), "ts_us": t * SECOND + i % 3} for i, t in enumerate(times)]


# A row that moves the watermark over all others.
END = {"event_id": -1, "user_id": 99, "ts_us": 100_000 * SECOND}


def test_limiter_counts_in_event_time_order(spark, tmp_path):
    rows = hits(200, 5)
    late = {"event_id": 777, "user_id": 1, "ts_us": 100 * SECOND}
    write_files(spark, tmp_path / "in", shuffled(rows, 1) + [END], HITS)
    write_files(spark, tmp_path / "in", [late, END | {"event_id": -2, "ts_us": 200_000 * SECOND}], HITS, 1)
    query = limiter.run_limiter(
        stream(spark, tmp_path / "in", HITS), str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "cp"), 60 * SECOND, delay=DELAY
    )
    query.awaitTermination(300)
    assert query.exception() is None
    batch = rate_limit(spark.createDataFrame([tuple(r.values()) for r in rows], HITS), 60 * SECOND)
    out = spark.read.parquet(str(tmp_path / "out"))
    names = ["event_id", "user_id", "window_start_us", "n_in_window", "limited"]
    assert differences(out.filter("event_id >= 0"), batch, names) == []
    assert out.filter("limited").count() > 10
    missed = spark.read.parquet(str(tmp_path / "late")).collect()
    assert [(r.event_id, r.n_in_window, r.late) for r in missed] == [(777, None, True)]


FILES = "event_id bigint, content_sha string, ts_us bigint"
RESULTS = "event_id bigint, content_sha string, summary string, ok boolean, ts_us bigint"


def files_and_results(seed):
    rng = random.Random(seed)
    files = [
        {"event_id": i, "content_sha": rng.choice("abcdefgh"), "ts_us": t * SECOND}
        for i, t in enumerate(sorted(rng.sample(range(900), 120)))
    ]
    results = [
        {"event_id": f["event_id"], "content_sha": f["content_sha"], "summary": rng.choice(["", f"s{f['event_id']}", f"s{f['event_id']}"]),
         "ok": rng.random() < 0.8, "ts_us": f["ts_us"] + rng.choice([0, 3, 70]) * SECOND}
        for f in files if rng.random() < 0.7
    ]
    return files, results


def write_files_and_results(spark, tmp_path, files, results, n=3):
    write_files(spark, tmp_path / "files", files, FILES, n)
    write_files(spark, tmp_path / "results", results, RESULTS, n)


def cache_stream(spark, tmp_path, **more):
    return cache_streams.probe_cache_stream(
        stream(spark, tmp_path / "files", FILES), stream(spark, tmp_path / "results", RESULTS), delay=DELAY, **more
    )


def test_cache_stream_equals_batch_over_a_restart(spark, tmp_path):
    files, results = files_and_results(2)
    known = spark.createDataFrame([("a", 5 * SECOND, "old")], "content_sha string, ready_us bigint, summary string")
    end = {"event_id": -1, "content_sha": "end", "ts_us": 100_000 * SECOND}
    half_f, half_r = shuffled(files, 3), shuffled(results, 4)
    cut = 450 * SECOND
    early = [r for r in half_f if r["at"] < cut], [r for r in half_r if r["at"] < cut]
    write_files_and_results(spark, tmp_path, *early)
    collect(spark, cache_stream(spark, tmp_path, cache=known), tmp_path, "cache")
    rest = [r for r in half_f if r["at"] >= cut], [r for r in half_r if r["at"] >= cut]
    write_files_and_results(spark, tmp_path, rest[0] + [end], rest[1] + [end | {"summary": None, "ok": False}])
    out = collect(spark, cache_stream(spark, tmp_path, cache=known), tmp_path, "cache")

    done = spark.createDataFrame([tuple(r[c] for c in ("event_id", "content_sha", "summary", "ok", "ts_us")) for r in results], RESULTS)
    old = spark.createDataFrame([(-5, "a", "old", True, 5 * SECOND)], RESULTS)
    cache = build_cache(done.unionByName(old).withColumnRenamed("ts_us", "done_us"))
    batch = probe_cache(spark.createDataFrame([tuple(f.values()) for f in files], FILES), cache)
    batch = batch.withColumn("summary", F.when(F.col("hit"), F.col("summary")))
    assert out.filter("late").count() == 0
    assert differences(out.filter("event_id >= 0"), batch, ["event_id", "content_sha", "hit", "summary"]) == []
    assert 20 < out.filter("hit").count() < 110


def single_flight(files, results, wait_us):
    """One content at work at a time, by an event list."""
    todo = [(r["ts_us"], 0, r["event_id"], "result", r) for r in results]
    todo += [(f["ts_us"], 2, f["event_id"], "file", f) for f in files]
    cached, at_work, queue, out = {}, {}, {}, {}
    while todo:
        todo.sort(key=lambda x: x[:3])
        ts, _, event_id, kind, row = todo.pop(0)
        sha = row["content_sha"]
        waiting = queue.setdefault(sha, [])

        def go(event):
            at_work[sha] = event["event_id"]
            out[event["event_id"]] = ("compute", None)
            todo.append((ts + wait_us, 1, event["event_id"], "deadline", event))

        if kind == "result" and row["ok"] and row["summary"] and sha not in cached:
            cached[sha] = row["summary"]
            for event in waiting:
                out[event["event_id"]] = ("waited", row["summary"])
            waiting.clear()
            at_work[sha] = None
        elif kind in ("result", "deadline") and at_work.get(sha) == event_id:
            at_work[sha] = None
            if waiting:
                go(waiting.pop(0))
        elif kind == "deadline" and row in waiting:
            waiting.remove(row)
            out[event_id] = ("timeout", None)
        elif kind == "file" and sha in cached:
            out[event_id] = ("hit", cached[sha])
        elif kind == "file" and at_work.get(sha) is None:
            go(row)
        elif kind == "file":
            waiting.append(row)
            todo.append((ts + wait_us, 1, event_id, "deadline", row))
    return out


def test_a_content_is_worked_on_once_at_a_time(spark, tmp_path):
    files, results = files_and_results(7)
    end = {"event_id": -1, "content_sha": "end", "ts_us": 100_000 * SECOND}
    write_files_and_results(spark, tmp_path, shuffled(files, 1) + [end], shuffled(results, 2) + [end | {"summary": None, "ok": False}])
    out = collect(spark, cache_stream(spark, tmp_path, wait_ms=50_000), tmp_path, "cache")
    got = {r.event_id: (r.route, r.summary) for r in out.collect() if r.event_id >= 0}
    want = single_flight(files, results, 50 * SECOND)
    assert got == want and {r for r, _ in want.values()} >= {"hit", "compute", "waited"}


REQUESTS = "request_id bigint, ts_us bigint"
DONE = "request_id bigint, value string, ts_us bigint"


@pytest.mark.parametrize("with_submitted", [True, False])
def test_deadlines_as_timers(spark, tmp_path, with_submitted):
    rng = random.Random(3)
    submitted = [{"request_id": i, "ts_us": (i * 9 + 1) * SECOND} for i in range(90)]
    polls = [{"request_id": r["request_id"], "ts_us": r["ts_us"] + rng.choice([-1, 0, 4]) * SECOND} for r in submitted]
    polls += [{"request_id": 500 + i, "ts_us": i * 40 * SECOND} for i in range(10)]
    results = [
        {"request_id": r["request_id"], "value": rng.choice(["v", "v", "v", ""]), "ts_us": r["ts_us"] + rng.randrange(-2000, 40_000) * 1000}
        for r in submitted if r["request_id"] % 6
    ]
    results += [r | {"value": "again", "ts_us": r["ts_us"] + 7 * SECOND} for r in results[::3]]
    end = {"request_id": -1, "ts_us": 100_000 * SECOND, "value": "x"}
    for name, rows, schema, seed in (("polls", polls, REQUESTS, 1), ("done", results, DONE, 2), ("sent", submitted, REQUESTS, 3)):
        write_files(spark, tmp_path / name, shuffled(rows, seed) + [end], schema, 3)
    known = stream(spark, tmp_path / "sent", REQUESTS).select("request_id", "ts") if with_submitted else None
    out = poll_streams.poll_clients_stream(
        stream(spark, tmp_path / "polls", REQUESTS).select("request_id", "ts"),
        stream(spark, tmp_path / "done", DONE).withColumnRenamed("ts", "done_ts"),
        {"web": S.WEB_POLL, "bot": S.BOT_ANSWER_POLL},
        known,
        DELAY,
    )
    got = collect(spark, out, tmp_path, "poll").filter("request_id >= 0")
    table = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    batch = polling.poll_as(
        table(polls, REQUESTS),
        table(results, DONE).withColumnRenamed("ts_us", "done_us"),
        {"web": S.WEB_POLL, "bot": S.BOT_ANSWER_POLL},
        table(submitted, REQUESTS) if with_submitted else None,
    )
    assert got.filter("late").count() == 0
    names = ["request_id", "ts_us", "client", "outcome", "observed_ms"]
    told = got.filter("client is not null")
    assert differences(told, batch, names) == []
    assert {r.outcome for r in told.collect()} == {"done", "timeout", "not_found"}
    if not with_submitted:
        return
    # A web client that gave up, and nobody else waiting, makes a result a late one.
    assert all(r.outcome == "late_result" for r in got.filter("client is null").collect())


def test_late_result_is_told_and_kept(spark, tmp_path):
    at = lambda second: {"ts_us": second * SECOND, "at": second * SECOND}
    write_files(spark, tmp_path / "polls", [{"request_id": 1} | at(1), {"request_id": 2} | at(550)], REQUESTS, 2)
    rows = [{"request_id": 1, "value": "v"} | at(45), {"request_id": 3, "value": ""} | at(900)]
    write_files(spark, tmp_path / "done", rows, DONE, 2)
    out = poll_streams.poll_stream(
        stream(spark, tmp_path / "polls", REQUESTS).select("request_id", "ts"),
        stream(spark, tmp_path / "done", DONE).withColumnRenamed("ts", "done_ts"),
        S.WEB_POLL,
        "1 second",
    )
    got = [(r.request_id, r.outcome, r.observed_ms) for r in collect(spark, out, tmp_path, "poll").collect()]
    assert sorted(got, key=repr) == [(1, "late_result", None), (1, "timeout", 30_000), (2, "timeout", 30_000)]
    # The worker's state log has the result whatever the client saw.
    log = [("1", "processing", 0, True, 1), ("1", "v", 1, True, 45)]
    state = spark.createDataFrame(log, "request_id string, value string, state_rank int, ok boolean, t int")
    from parchmill.operators.state import latest_state

    assert latest_state(state.withColumn("ts", F.timestamp_seconds("t")).drop("t")).first().value == "v"


EVENTS = "event_id bigint, user_id bigint, ts_us bigint, kind string, file_key bigint, content_sha string"
BOT_RESULTS = "event_id bigint, service string, ts_us bigint, body string, error string"


def test_bot_stream_equals_batch(spark, tmp_path):
    window = 120 * SECOND
    events = [e | {"error": "broken" if e["event_id"] % 9 == 0 else None} for e in bot_events(220, 4)]
    table, results = frame(spark, events), results_of(spark, events)
    batch = bot.replies(bot.start(table, results, window).routes())
    end = {"event_id": 10_000, "user_id": 50, "ts_us": 100_000 * SECOND, "kind": "exit"}
    sent = [r.asDict() for r in table.drop("latency_ms").collect()]
    done = [r.asDict() for r in results.withColumnRenamed("done_us", "ts_us").collect()]
    write_files(spark, tmp_path / "events", shuffled(sent, 1) + [end], EVENTS, 5, 4300 * SECOND)
    last = {"event_id": 20_000, "service": "summary", "ts_us": 100_000 * SECOND, "body": "x"}
    write_files(spark, tmp_path / "results", shuffled(done, 2) + [last], BOT_RESULTS, 5, 4300 * SECOND)
    out = bot_streams.reply_stream(stream(spark, tmp_path / "events", EVENTS), stream(spark, tmp_path / "results", BOT_RESULTS), window, delay=DELAY)
    got = collect(spark, out, tmp_path, "bot")
    assert got.filter("late").count() == 0
    names = ["event_id", "user_id", "route", "last_file", "outcome", "observed_ms", "reply"]
    assert differences(got.filter("event_id < 10000"), batch, names) == []
    seen = {(r.route, r.outcome) for r in got.collect()}
    assert seen >= {("question", "done"), ("question", "error"), ("summarize_file", "error"), ("summarize_file", "timeout"),
                    ("cache_hit", None), ("rate_limited", None), ("qa_no_file", None)}


def test_bot_session_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i, t in enumerate(sorted(rng.sample(range(2000), 200))):
        kind = rng.choices(["text", "file", "enter", "exit"], [4, 4, 3, 1])[0]
        limited, hit = rng.random() < 0.1, kind == "file" and rng.random() < 0.2
        rows.append((i, rng.choice([1, 2]), t * SECOND, kind, rng.randrange(9), 1000, limited and kind in ("text", "file"), hit and not limited))
    schema = "event_id bigint, user_id bigint, ts_us bigint, kind string, file_key bigint, latency_ms bigint, limited boolean, hit boolean"
    flow = spark.createDataFrame(rows, schema).withColumns({"content_sha": F.lit("s"), "cached": F.lit(None).cast("string")})
    is_message = F.col("kind").isin("text", "file")
    batch = sessions.route_bot(flow.filter(is_message), flow.filter(~is_message))
    done = sessions.completions(flow.filter(is_message)).withColumns({"limited": F.lit(False), "hit": F.lit(False)})
    kept = schema.replace(", latency_ms bigint", "")
    names = [c.split()[0] for c in kept.split(", ")]
    replay = [r.asDict() for r in flow.select(*names).unionByName(done.select(*names)).collect()]
    write_files(spark, tmp_path / "in", shuffled(replay, 5) + [END | {"kind": "exit"}], kept)
    out = collect(spark, session_streams.route_bot_stream(stream(spark, tmp_path / "in", kept), DELAY), tmp_path, "bot")
    assert differences(out.filter("event_id >= 0"), batch, ["event_id", "route", "last_file"]) == []


def test_web_session_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "event_id bigint, user_id bigint, ts_us bigint, kind string, user_text string"
    rows = [
        (i, rng.choice([1, 2, 3]), i * 5 * SECOND, rng.choice(["text", "text", "upload", "continue", "ask"]), rng.choice(["a", " "]))
        for i in range(250)
    ]
    batch = sessions.route_web(spark.createDataFrame(rows, schema.replace("user_text", "text")))
    replay = [r.asDict() for r in batch.select("event_id", "user_id", "ts_us", "kind", "user_text").collect()]
    write_files(spark, tmp_path / "in", shuffled(replay, 5) + [END | {"kind": "ask"}], schema)
    out = collect(spark, session_streams.route_web_stream(stream(spark, tmp_path / "in", schema), DELAY), tmp_path, "web")
    assert differences(out.filter("event_id >= 0"), batch, ["event_id", "segment", "action", "route"]) == []


def test_transcript_stream_equals_batch(spark, tmp_path, sf_dir):
    messages = inputs.transcript_messages(spark, sf_dir).drop("file_info")
    batch = sessions.transcript(messages)
    schema = "conv_id bigint, turn bigint, type string, text string, target string, asks boolean, ts_us bigint"
    rows = [r.asDict() | {"ts_us": (r["turn"] * 30 + r["conv_id"] % 7) * SECOND} for r in messages.collect()]
    end = {"conv_id": -1, "turn": 0, "type": "user", "text": "x", "target": "main", "asks": False, "ts_us": 100_000 * SECOND}
    write_files(spark, tmp_path / "in", shuffled(rows, 2) + [end], schema, 3)
    source = stream(spark, tmp_path / "in", schema).withColumn("file_info", F.lit(None).cast(S.FILE_INFO))
    out = collect(spark, session_streams.transcript_stream(source, DELAY), tmp_path, "talk")
    assert out.filter("late").count() == 0
    assert differences(out.filter("conv_id >= 0"), batch, ["conv_id", "turn", "target", "segment", "seq", "type", "text"]) == []
