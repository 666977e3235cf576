from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parchmill.operators.limits import WINDOW_US, rate_limit
from parchmill.operators.slices import find_slices

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
HITS = "event_id bigint, user_id bigint, ts_us bigint"


def model(rows, window, limit=5):
    """The limiter, hit by hit."""
    opened, out = {}, {}
    for event_id, user, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, n = opened.get(user, (None, 0))
        if start is None or ts >= start + window:
            start, n = ts, 0
        opened[user] = (start, n + 1)
        out[event_id] = (start, n + 1, n + 1 > limit)
    return out


def run(spark, rows, window, slices=None):
    df = spark.createDataFrame(rows, HITS)
    got = rate_limit(df, window, slices=slices(df) if slices else None).collect()
    assert len(got) == len(rows)
    return {r.event_id: (r.window_start_us, r.n_in_window, r.limited) for r in got}


def test_boundaries(spark):
    second = 1_000_000
    at = [0, 1, 2, 3, 4, 59.9, 60, 300, 300.5]
    rows = [(i, 1, int(t * second)) for i, t in enumerate(at)]
    got = run(spark, rows, WINDOW_US)
    assert [got[i][1] for i in range(9)] == [1, 2, 3, 4, 5, 6, 1, 1, 2]
    assert [got[i][2] for i in range(9)] == [False] * 5 + [True] + [False] * 3


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400)), min_size=1, max_size=120), st.integers(1, 90))
def test_equals_the_sequential_model(spark, hits, window):
    rows = [(i, u, t) for i, (u, t) in enumerate(hits)]
    assert run(spark, rows, window) == model(rows, window)


def test_windows_reach_over_arrow_batches(spark):
    rows = [(i, 1 + (i > 700), i * 7 % 5000) for i in range(1500)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")
    try:
        assert run(spark, rows, 100) == model(rows, 100)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("window", [3, 50, 700])
def test_hot_users_are_cut_and_counted_the_same(spark, window):
    rng = random.Random(window)
    rows = [(i, 0 if i % 3 else rng.randrange(1, 40), rng.randrange(20_000)) for i in range(3000)]
    # A burst: many hits in little time, some at the same instant.
    rows += [(3000 + i, 0, 5000 + rng.randrange(60)) for i in range(600)]

    def cut(df):
        slices = find_slices(df, "user_id", "ts_us", hot_rows=100)
        assert slices.any_hot and slices.max_slices > 8 and len(slices.levels) > 1
        return slices

    assert run(spark, rows, window, cut) == model(rows, window)


def test_no_hot_user_no_slices(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], HITS)
    assert not find_slices(df, "user_id", "ts_us").any_hot


def test_partitions_split_by_an_earlier_join_do_no_harm(spark):
    """A skewed join on the user before the limiter, with adaptive splitting forced."""
    rows = [(i, 0 if i % 2 else i % 40, i * 3) for i in range(20_000)]
    hits = spark.createDataFrame(rows, HITS)
    names = spark.createDataFrame([(u, f"n{u}") for u in range(40)], "user_id bigint, name string")
    forced = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    }
    for key, value in forced.items():
        spark.conf.set(key, value)
    try:
        got = rate_limit(hits.join(names, "user_id"), 100).collect()
        df = hits.join(names, "user_id")
        cut = rate_limit(df, 100, slices=find_slices(df, "user_id", "ts_us", hot_rows=2000)).collect()
    finally:
        for key in forced:
            spark.conf.unset(key)
    want = model(rows, 100)
    for result in (got, cut):
        assert {r.event_id: (r.window_start_us, r.n_in_window, r.limited) for r in result} == want


@pytest.mark.parametrize("batch", [3, 10_000])
def test_null_and_very_large_user_ids_are_users_of_their_own(spark, batch):
    big = 2**60
    users = [None, big, big + 1, None, big, big + 1, 2**53 + 1, 2**53]
    rows = [(i, user, i * 1000) for i, user in enumerate(users * 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = run(spark, rows, WINDOW_US)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = model([(i, -1 if user is None else user, ts) for i, user, ts in rows], WINDOW_US)
    assert got == want


def test_hits_of_no_user_are_cut_too(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 3 else rng.randrange(1, 40), rng.randrange(20_000)) for i in range(3000)]
    plain = model([(e, -1 if u is None else u, t) for e, u, t in rows], 700)

    def cut(df):
        slices = find_slices(df, "user_id", "ts_us", hot_rows=100)
        assert slices.any_hot and slices.max_slices > 8
        assert slices.hot(df).filter("user_id is null").count() == 2000
        return slices

    assert run(spark, rows, 700, cut) == plain
