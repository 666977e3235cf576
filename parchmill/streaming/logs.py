"""Request latencies from log streams: starts and ends paired in event-time order, and running counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery

from parchmill.operators import logs
from parchmill.sources import results
from parchmill.streaming.ordered import LATE, Ordered, run_ordered, timed

KEEP_US = 3_600 * 1_000_000
DAY_MS = 86_400_000

_ROW = T.StructType(
    [
        T.StructField("ts_us", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
    ]
)
_PAIRED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("state", T.StringType()),
        LATE,
    ]
)
COUNTS = "day date, service string, latency_ms bigint, n bigint"


class Pairing(Ordered):
    """State per request: its first start, until an hour after its end or its last line.

    States that come out: ``done`` at the first end, ``open`` when none came within ``open_us`` of the start; an end
    after that still comes out as ``done``. An end without a start comes out without a latency, as in the batch form.
    """

    # Of lines of one instant the start is first.
    order = ("event",)

    def __init__(self, open_us: int):
        self.open_us, self.row, self.output = open_us, _ROW, _PAIRED

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", "start_us bigint, n_chars int, ended boolean, last_us bigint")

    def load(self, key: tuple) -> None:
        stored = self.request.get() if self.request.exists() else (None, None, False, 0)
        self.start_us, self.n_chars, self.ended, self.last_us = stored

    def save(self, key: tuple) -> None:
        self.request.update((self.start_us, self.n_chars, self.ended, self.last_us))

    def idle_at(self) -> int | None:
        return self.request.get()[3] + KEEP_US if self.request.exists() else None

    def give_up(self) -> None:
        self.request.clear()

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        service, _, mark = row["event"].rpartition("_")
        self.last_us = row["ts_us"]
        if mark == "start" and self.start_us is None:
            self.start_us, self.n_chars = row["ts_us"], row["n_chars"]
            self.hold({"ts_us": row["ts_us"] + self.open_us, "event": f"{service}_zlimit"})
        elif mark == "end" and not self.ended:
            self.ended = True
            yield self._told(key, service, row["ts_us"], "done")
        elif mark == "zlimit" and not self.ended:
            yield self._told(key, service, None, "open")

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield {"request_id": key[0], "state": "late", "late": True}

    def _told(self, key: tuple, service: str, end_us: int | None, state: str) -> dict:
        start_ms = None if self.start_us is None else self.start_us // 1000
        end_ms = None if end_us is None else end_us // 1000
        return {
            "request_id": key[0],
            "service": service,
            "start_ms": start_ms,
            "end_ms": end_ms,
            "n_chars": self.n_chars,
            "latency_ms": None if start_ms is None or end_ms is None else end_ms - start_ms,
            "state": state,
            "late": False,
        }


def pair_stream(rows: DataFrame, open_after_ms: int = 600_000, delay: str = "1 minute") -> DataFrame:
    """Stream of marked log rows -> one row per request when it ends, and one with state ``open``
    for a request that has not ended in time."""
    marks = F.col("event").isin("summary_start", "summary_end", "question_start", "question_end")
    wanted = rows.filter(marks & F.col("request_id").isNotNull()).select("request_id", "ts", "event", "n_chars")
    return run_ordered(timed(wanted, delay), ["request_id"], Pairing(open_after_ms * 1000))


def run_log_metrics(
    rows: DataFrame,
    counts_path: str,
    open_path: str,
    checkpoint: str,
    open_after_ms: int = 600_000,
    delay: str = "1 minute",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep two tables from a stream of marked log rows: latency counts per day, and open requests.

    The counts of a micro-batch are a few rows, and counts add up, so any span of days is a sum of them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            day = F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", F.col("start_ms"), F.lit(DAY_MS)).cast("int"))
            counts = logs.latency_counts(batch.filter("state = 'done'").withColumn("day", day), "day")
            results.write_batch(counts.coalesce(1), counts_path, batch_id, "logs")
            results.write_batch(batch.filter("state = 'open'").coalesce(1), open_path, batch_id, "logs")
        finally:
            batch.unpersist()

    return (
        pair_stream(rows, open_after_ms, delay)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_metrics(spark: SparkSession, counts_path: str, *keys: str) -> DataFrame:
    """``latency_stats`` of all that was counted so far; with ``day`` among the keys per day."""
    counts = spark.read.schema(COUNTS).parquet(counts_path)
    merged = counts.groupBy(*keys, "service", "latency_ms").agg(F.sum("n").alias("n"))
    return logs.stats_of_counts(merged, *keys)
