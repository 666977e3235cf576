from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import polling, state
from parchmill.operators.summarize import summarize
from parchmill.sources import results


def log(spark, rows):
    df = spark.createDataFrame(rows, "request_id string, value string, state_rank int, ok boolean, t int")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_latest_and_status(spark):
    rows = [
        ("a", "processing", 0, True, 1), ("a", "sum", 1, True, 1),
        ("b", "processing", 0, True, 1),
        ("c", "processing", 0, True, 1), ("c", "", 1, True, 2),
        ("d", S.SUMMARY_FAILED, 1, False, 3), ("d", "old", 1, True, 2),
        ("e", None, 1, True, 1),
    ]
    latest = state.latest_state(log(spark, rows))
    asked = spark.createDataFrame([(c,) for c in "abcdefa"], "request_id string")
    got = [tuple(r) for r in state.lookup_status(asked, latest).select("request_id", "status", "summary", "ok").collect()]
    assert sorted(got, key=repr) == sorted(
        [
            ("a", "done", "sum", True),
            ("a", "done", "sum", True),
            ("b", "processing", None, True),
            ("c", "not_found", None, False),
            ("d", "done", S.SUMMARY_FAILED, False),
            ("e", "not_found", None, False),
            ("f", "not_found", None, False),
        ],
        key=repr,
    )


def test_cache(spark):
    logged = spark.createDataFrame(
        [("x", "late", 20, 2, True), ("x", "early", 10, 1, True), ("x", "failed", 5, 0, False), ("y", "failed", 1, 3, False)],
        "content_sha string, summary string, done_us bigint, event_id bigint, ok boolean",
    )
    cache = state.build_cache(logged)
    assert [tuple(r) for r in cache.collect()] == [("x", 10, "early")]
    more = spark.createDataFrame([("x", 3, "older"), ("z", 4, "new")], cache.schema)
    assert sorted(tuple(r) for r in state.merge_cache(cache, more).collect()) == [("x", 3, "older"), ("z", 4, "new")]
    files = spark.createDataFrame([(1, "x", 9), (2, "x", 10), (3, "y", 99)], "id int, content_sha string, ts_us bigint")
    assert {r.id: r.hit for r in state.probe_cache(files, cache).collect()} == {1: False, 2: True, 3: False}
    assert [r.id for r in state.cache_hits(files, cache).collect()] == [2]
    assert sorted(r.id for r in state.cache_misses(files, cache).collect()) == [1, 3]


def test_cache_log(spark, tmp_path):
    for batch, rows in enumerate([[("x", "a", 20, 1, True)], [("x", "b", 10, 2, True), ("y", "c", 5, 3, False)]]):
        results.append_cache(spark.createDataFrame(rows, S.CACHE_LOG), str(tmp_path / "cache"), batch)
    assert [tuple(r) for r in results.read_cache(spark, str(tmp_path / "cache")).collect()] == [("x", 10, "b")]


def test_compute_once_runs_per_distinct_content(spark):
    df = spark.createDataFrame([(i, f"Text {i % 3}. More.") for i in range(30)], "i int, text string")
    seen = []

    def compute(distinct):
        seen.append(distinct.count())
        return summarize(distinct)

    out = state.compute_once(df, "text", compute, ["summary"])
    assert seen == [3]
    assert {(r.i, r.summary) for r in out.collect()} == {(i, f"Text {i % 3} More.") for i in range(30)}


@pytest.mark.parametrize(
    "policy,latency,want",
    [
        (S.BOT_SUMMARY_POLL, 0, ("done", 2000)),
        (S.BOT_SUMMARY_POLL, 2001, ("done", 4000)),
        (S.BOT_SUMMARY_POLL, 240_000, ("done", 240_000)),
        (S.BOT_SUMMARY_POLL, 240_001, ("timeout", 240_000)),
        (S.BOT_SUMMARY_POLL, None, ("timeout", 240_000)),
        (S.BOT_ANSWER_POLL, 120_001, ("timeout", 120_000)),
        (S.WEB_POLL, 0, ("done", 0)),
        (S.WEB_POLL, 1, ("done", 1000)),
        (S.WEB_POLL, 29_000, ("done", 29_000)),
        (S.WEB_POLL, 29_001, ("timeout", 30_000)),
    ],
)
def test_poll_boundaries(spark, policy, latency, want):
    requests = spark.createDataFrame([(1, 1_000_000)], "request_id int, ts_us bigint")
    done = [] if latency is None else [(1, 1_000_000 + latency * 1000), (1, 999_000_000_000)]
    written = spark.createDataFrame(done, "request_id int, done_us bigint")
    row = polling.poll(requests, written, policy).first()
    assert (row.outcome, row.observed_ms) == want


def test_unknown_ids_fail_at_once_for_the_page_only(spark):
    df = spark.createDataFrame([(None, False)], "lat bigint, known boolean")
    for policy, want in ((S.WEB_POLL, ("not_found", 0)), (S.BOT_ANSWER_POLL, ("timeout", 120_000))):
        assert tuple(df.select(*polling.outcome(F.col("lat"), policy, F.col("known"))).first()) == want


def test_an_empty_result_is_no_result(spark):
    df = spark.createDataFrame([(100, "x"), (100, ""), (10**9, "")], "latency bigint, text string")
    for policy, want in ((S.WEB_POLL, ["done", "not_found", "timeout"]), (S.BOT_SUMMARY_POLL, ["done", "timeout", "timeout"])):
        seen, _ = polling.outcome(F.col("latency"), policy, has_text=F.col("text") != "")
        assert [r[0] for r in df.select(seen).collect()] == want
    results = spark.createDataFrame([("a", "", 1, 1, True), ("a", "s", 2, 2, True), ("b", "", 1, 3, True)],
                                    "content_sha string, summary string, done_us long, event_id long, ok boolean")
    assert [tuple(r) for r in state.build_cache(results).select("content_sha", "summary").collect()] == [("a", "s")]
