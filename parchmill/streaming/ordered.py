"""Keyed streaming state in event-time order.

A row waits in the state of its key until the watermark has passed it; then the rows that waited
are worked on by time, whatever order they came in. A row that comes behind the watermark can't be put
in its place any more: it comes out at once, marked ``late``, and changes nothing.

So every row of the input comes out once, and rows on time come out as in a batch over the whole
table. A restarted query goes on from its checkpoint, waiting rows and timers included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parchmill.session import configure_streaming
from parchmill.sources.results import write_batch

# Spark drops rows behind the watermark before any state sees them. The event time it is given is
# later by this much, and so is the delay: the watermark is the same, and rows late by less still come.
GRACE_DAYS = 20_000
EVENT_TIME = "event_time"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# A late row can't be given to a following step with its own time.
_FOR_LATE = _EPOCH + timedelta(days=3 * GRACE_DAYS)
LATE = T.StructField("late", T.BooleanType())
EVENT = T.StructField(EVENT_TIME, T.TimestampType())


def timed(rows: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Add ``event_time``, whose watermark is the newest ``ts`` less ``delay``, and ``ts_us``.

    A row without a time counts as late.
    """
    configure_streaming(rows.sparkSession)
    return rows.withColumn("ts_us", F.unix_micros(ts)).transform(after_watermark, delay)


def after_watermark(rows: DataFrame, delay: str) -> DataFrame:
    """As ``timed``, of rows that have ``ts_us``."""
    shifted = F.timestamp_micros(F.col("ts_us")) + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")
    return rows.withColumn(EVENT_TIME, shifted).withWatermark(EVENT_TIME, f"{delay} {GRACE_DAYS} days")


class Ordered(StatefulProcessor):
    """Base of processors that work on a key's rows by time.

    ``row`` is the type of the rows that wait: ``ts_us`` and whatever ``step`` reads. ``order`` breaks ties
    of equal time. ``output`` is the type of what comes out. With ``trusting`` a row's own ``late`` says whether it is:
    it comes from a step before, which puts rows out when the watermark has passed them.
    """

    row: T.StructType
    output: T.StructType
    order: tuple[str, ...] = ("event_id",)
    trusting = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.alarm = handle.getValueState("alarm", T.StructType([T.StructField("at_ms", T.LongType())]))
        self.open(handle)

    # --- what a processor says -------------------------------------------------------

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the state variables."""

    def load(self, key: tuple) -> None:
        """Read the state of a key; some steps and a ``save`` follow."""

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        """Work on one row; all earlier ones of the key were worked on before."""
        raise NotImplementedError

    def save(self, key: tuple) -> None:
        """Write the state of a key, or clear what is not needed any more."""

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        """What comes out for a row behind the watermark."""
        raise NotImplementedError

    def idle_at(self) -> int | None:
        """When the state just saved may be given up, in microseconds, if no row comes before; None: never."""
        return None

    def give_up(self) -> None:
        """Clear the state variables."""

    def passes(self, row: Row) -> bool:
        """Is the row none of this step's business? Then it goes through at once as it is."""
        return False

    def hold(self, row: dict) -> None:
        """From a step: a row of one's own, for a later step at its ``ts_us``."""
        self._held.append(row)

    # --- how it is run ---------------------------------------------------------------

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = []
        for row in rows:
            if row["late"] if self.trusting else row["ts_us"] is None or row["ts_us"] < horizon:
                yield from map(self._out, self.late(key, row.asDict()))
            elif self.passes(row):
                yield self._out(row.asDict())
            else:
                fresh.append({n: row[n] for n in self.row.names})
        if fresh:
            yield from self._work(key, fresh, horizon)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.clear()
        yield from self._work(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _work(self, key: tuple, fresh: list[dict], horizon: int) -> Iterator[Row]:
        """Take the steps of all rows that the watermark has passed, and wait with the rest."""
        names = self.row.names
        stored = [dict(zip(names, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due, rest, number = [], [], 0
        for row in stored + fresh:
            if row["ts_us"] < horizon:
                due.append((self._place(row), number, row))
                number += 1
            else:
                rest.append(row)
        worked = bool(due)
        if worked:
            heapq.heapify(due)
            self.load(key)
            while due:
                self._held = []
                yield from map(self._out, self.step(key, heapq.heappop(due)[2]))
                for row in self._held:
                    if row["ts_us"] < horizon:
                        heapq.heappush(due, (self._place(row), number, row))
                        number += 1
                    else:
                        rest.append(row)
            self.save(key)
        if not worked:
            if fresh:
                self.waiting.appendList([tuple(r.get(n) for n in names) for r in fresh])
        elif rest:
            self.waiting.put([tuple(r.get(n) for n in names) for r in rest])
        else:
            self.waiting.clear()
        if rest:
            self._wake(min(r["ts_us"] for r in rest), horizon)
        elif (idle := self.idle_at()) is not None:
            if idle < horizon:
                self.give_up()
            else:
                self._wake(idle, horizon)

    def close(self) -> None:
        pass

    def _place(self, row: dict) -> tuple:
        return row["ts_us"], *((row.get(n) is not None, row.get(n)) for n in self.order)

    def _wake(self, at_us: int, horizon: int) -> None:
        """Set the key's one timer, after the watermark of the batch: Spark does not look at earlier ones again."""
        at_ms = max(at_us, horizon) // 1000 + 1
        if self.alarm.exists():
            known = self.alarm.get()[0]
            if known == at_ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at_ms)
        self.alarm.update((at_ms,))

    def _out(self, values: dict) -> Row:
        if EVENT_TIME in self.output.names and EVENT_TIME not in values:
            values = values | {EVENT_TIME: _FOR_LATE if values.get("late") else shifted(values["ts_us"])}
        return Row(**{n: values.get(n) for n in self.output.names})


def shifted(ts_us: int) -> datetime:
    """The event time that a following step is given."""
    return _EPOCH + timedelta(days=GRACE_DAYS, microseconds=ts_us)


def run_ordered(rows: DataFrame, keys: list[str], processor: Ordered, initial: DataFrame | None = None) -> DataFrame:
    """``processor`` over a stream made by ``timed``.

    If its output has an ``event_time`` (``later``), the result is such a stream itself: what one step
    puts out at a watermark, the next step works on at the same.
    """
    chained = EVENT_TIME in processor.output.names
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor,
        outputStructType=processor.output,
        outputMode="append",
        timeMode="eventTime",
        initialState=None if initial is None else initial.groupBy(*keys),
        eventTimeColumnName=EVENT_TIME if chained else "",
    )


def write_split(
    rows: DataFrame, path: str, late_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write a stream of ``run_ordered`` to two tables, rows on time and late rows; a replayed batch replaces itself."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(batch.filter(~F.col("late")), path, batch_id, "stream")
            write_batch(batch.filter("late"), late_path, batch_id, "stream")
        finally:
            batch.unpersist()

    return (
        rows.drop(EVENT_TIME)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
