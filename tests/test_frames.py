from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parchmill import schemas as S
from parchmill.operators import frames

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROW = "topic string, key string, value binary, timestamp timestamp"


def parse(spark, rows, wire):
    df = spark.createDataFrame([(t, None, v, None) for t, v in rows], ROW)
    return [(r.reason, r.request_id, r.text, r.question) for r in frames.parse_frames(df, wire).collect()]


def test_delimited(spark):
    rows = [
        ("summarize", b"id"),
        ("summarize", b"id|text"),
        ("summarize", b"id|a|b"),
        ("summarize", b"id|"),
        ("question", b"id|ctx"),
        ("question", b"id|ctx|q"),
        ("question", b"id|c|tx|q"),
        ("question", b"id|ctx|q|q2"),
        ("summarize", b"\xff\xfe|x"),
        ("other", b"id|x"),
    ]
    bad = "malformed frame"
    assert parse(spark, rows, "delimited") == [
        (bad, None, None, None),
        (None, "id", "text", None),
        (None, "id", "a|b", None),
        (None, "id", "", None),
        (bad, None, None, None),
        (None, "id", "ctx", "q"),
        (None, "id", "c", "tx|q"),
        (None, "id", "ctx", "q|q2"),
        ("not UTF-8", None, None, None),
        ("unknown topic", None, None, None),
    ]


def test_bad_json_is_a_dead_letter(spark):
    rows = [("summarize", b"{"), ("summarize", b'{"request_id":"a"}'), ("question", b'{"request_id":"a","text":"t"}')]
    assert [r[0] for r in parse(spark, rows, "json")] == ["malformed frame"] * 3
    df = spark.createDataFrame([("summarize", None, b"{", None)], ROW)
    letters = frames.dead_letters(frames.parse_frames(df)).collect()
    assert [(r.topic, bytes(r.value), r.reason) for r in letters] == [("summarize", b"{", "malformed frame")]


@FEW
@given(st.lists(st.tuples(st.text(max_size=20), st.text(max_size=20)), min_size=1, max_size=6))
def test_json_frames_keep_any_text(spark, pairs):
    surrogate_free = [(t, q) for t, q in pairs if all(not 0xD800 <= ord(c) < 0xE000 for c in t + q)]
    rows = [(f"r{i}", t, q, None) for i, (t, q) in enumerate(surrogate_free)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "request_id string, text string, question string, ts timestamp")
    back = frames.parse_frames(frames.question_frames(df)).collect()
    assert sorted((r.request_id, r.text, r.question) for r in back) == sorted(r[:3] for r in rows)


def test_processing_rows_and_ids(spark):
    df = spark.createDataFrame([("t",), ("u",)], "text string").selectExpr("text", "timestamp_seconds(0) as ts")
    with_id = frames.with_request_id(df).persist()
    ids = {r.request_id for r in with_id.collect()}
    assert len(ids) == 2 and all(len(i) == 36 for i in ids)
    rows = frames.processing_rows(with_id)
    assert rows.columns == S.STATE_ROW.names
    assert {r.request_id for r in rows.collect()} == ids
