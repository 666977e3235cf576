"""The file cache on a stream: keyed by content, looked up in event-time order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from parchmill.streaming.ordered import LATE, Ordered, run_ordered, timed

# At one instant a result is there before a waiting ends, and both before a new file.
RANKS = {"result": 0, "deadline": 1, "file": 2}

_ROW = [
    T.StructField("ts_us", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("ok", T.BooleanType()),
]
OUTPUT = [
    T.StructField("event_id", T.LongType()),
    T.StructField("content_sha", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("route", T.StringType()),
    T.StructField("hit", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("answered_us", T.LongType()),
    LATE,
]


class FileCache(Ordered):
    """State per content: the earliest good result, for ever; with ``wait_us`` also the file whose result
    is awaited and the files that wait for it.

    Routes: ``hit`` (answered from the cache), ``compute`` (to be worked on), ``waited`` (answered when the
    awaited result came), ``timeout`` (it did not come in time), ``late`` (behind the watermark: not looked up).
    """

    order = ("rank", "event_id")

    def __init__(self, wait_us: int | None):
        self.wait_us = wait_us
        self.row, self.output = T.StructType(_ROW), T.StructType(OUTPUT)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cached = handle.getValueState("cached", "ready_us bigint, summary string")
        self.asked = handle.getValueState("asked", "event_id bigint")
        self.queue = handle.getListState("queue", "event_id bigint, ts_us bigint")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.cached.update((initialState["ready_us"], initialState["summary"]))

    def load(self, key: tuple) -> None:
        self.result = tuple(self.cached.get()) if self.cached.exists() else None
        self.at_work = self.asked.get()[0] if self.asked.exists() else None
        self.waiters = [tuple(w) for w in self.queue.get()] if self.queue.exists() else []

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] == "result":
            yield from self._result(key, row)
        elif row["kind"] == "deadline":
            if row["event_id"] == self.at_work:
                self.at_work = None
                yield from self._next(key, row["ts_us"])
            elif mine := [w for w in self.waiters if w[0] == row["event_id"]]:
                self.waiters = [w for w in self.waiters if w[0] != row["event_id"]]
                yield from (self._told(key, w, "timeout", answered_us=row["ts_us"]) for w in mine)
        elif self.result is not None and row["ts_us"] >= self.result[0]:
            yield self._told(key, (row["event_id"], row["ts_us"]), "hit", self.result[1], row["ts_us"])
        elif self.wait_us is None or self.at_work is None:
            yield self._compute(key, (row["event_id"], row["ts_us"]), row["ts_us"])
        else:
            self.waiters.append((row["event_id"], row["ts_us"]))
            self._deadline(row["event_id"], row["ts_us"])

    def save(self, key: tuple) -> None:
        if self.result is not None:
            self.cached.update(self.result)
        if self.wait_us is not None:
            if self.at_work is None:
                self.asked.clear()
            else:
                self.asked.update((self.at_work,))
            if self.waiters:
                self.queue.put(self.waiters)
            else:
                self.queue.clear()

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] == "file":
            yield self._told(key, (row["event_id"], row["ts_us"]), "late") | {"late": True}
        elif row["ok"] and row["summary"] and row["ts_us"] is not None:
            # Files that came since had no answer; the next ones have.
            if not self.cached.exists() or self.cached.get()[0] > row["ts_us"]:
                self.cached.update((row["ts_us"], row["summary"]))

    def _result(self, key: tuple, row: dict) -> Iterable[dict]:
        good = bool(row["ok"] and row["summary"])
        if good and self.result is None:
            self.result = (row["ts_us"], row["summary"])
            for waiter in self.waiters:
                yield self._told(key, waiter, "waited", row["summary"], row["ts_us"])
            self.waiters, self.at_work = [], None
        elif row["event_id"] == self.at_work:
            self.at_work = None
            yield from self._next(key, row["ts_us"])

    def _next(self, key: tuple, now_us: int) -> Iterable[dict]:
        """What was at work failed: the file that has waited longest goes on in its place."""
        if self.waiters:
            yield self._compute(key, self.waiters.pop(0), now_us)

    def _compute(self, key: tuple, file: tuple[int, int], now_us: int) -> dict:
        if self.wait_us is not None:
            self.at_work = file[0]
            self._deadline(file[0], now_us)
        return self._told(key, file, "compute")

    def _deadline(self, event_id: int, from_us: int) -> None:
        self.hold({"ts_us": from_us + self.wait_us, "rank": RANKS["deadline"], "event_id": event_id, "kind": "deadline"})

    def _told(
        self, key: tuple, file: tuple[int, int], route: str, summary: str | None = None, answered_us: int | None = None
    ) -> dict:
        return {
            "event_id": file[0],
            "content_sha": key[0],
            "ts_us": file[1],
            "route": route,
            "hit": summary is not None,
            "summary": summary,
            "answered_us": answered_us,
            "late": False,
        }


def probe_cache_stream(
    files: DataFrame,
    results: DataFrame,
    cache: DataFrame | None = None,
    delay: str = "10 seconds",
    wait_ms: int | None = None,
) -> DataFrame:
    """Streams of files (event_id, content_sha, ts) and results (event_id, content_sha, summary, ok, ts) -> one
    row per file: event_id, content_sha, ts_us, route, hit, summary, answered_us, late.

    A file is a hit if a good result of its content was there before, in ``cache`` (a table of content_sha,
    ready_us, summary that the state starts from) or on the stream: the same as ``probe_cache`` over all
    rows, whatever order they came in. With ``wait_ms`` a content is worked on once at a time: files that come meanwhile wait
    for that result at most so long, and the first of them takes over if it fails or does not come.
    """
    file_rows = files.select(
        "event_id", "content_sha", "ts", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("boolean").alias("ok"),
    )
    result_rows = results.select("event_id", "content_sha", "ts", F.lit("result").alias("kind"), "summary", "ok")
    rows = file_rows.unionByName(result_rows)
    rank = F.when(F.col("kind") == "result", RANKS["result"]).otherwise(RANKS["file"])
    initial = None if cache is None else cache.select("content_sha", "ready_us", "summary")
    processor = FileCache(None if wait_ms is None else wait_ms * 1000)
    return run_ordered(timed(rows.withColumn("rank", rank), delay), ["content_sha"], processor, initial)
