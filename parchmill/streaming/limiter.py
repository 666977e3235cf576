"""The rate limiter on a stream: hits are counted in event-time order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery

from parchmill import schemas as S
from parchmill.operators.limits import WINDOW_US
from parchmill.streaming.ordered import EVENT, LATE, Ordered, run_ordered, timed, write_split

_HIT = [T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType())]
_VERDICT = [
    T.StructField("window_start_us", T.LongType()),
    T.StructField("n_in_window", T.LongType()),
    T.StructField("limited", T.BooleanType()),
]


class WindowCounter(Ordered):
    """State per user: start of the open window and the hits in it.

    It is given up when the watermark has passed the end of the window. Rows of other kinds than
    ``counted``, if kinds are given, pass without being counted.
    """

    def __init__(
        self,
        user: T.StructField,
        window_us: int,
        limit: int,
        carried: list[T.StructField],
        counted: tuple[str, ...] = (),
        chained: bool = False,
    ):
        self.window_us, self.limit, self.counted, self.trusting = window_us, limit, counted, chained
        self.names, self.user = ["event_id", "ts_us", *(f.name for f in carried)], user.name
        self.row = T.StructType([*_HIT, *carried])
        self.output = T.StructType([*_HIT, user, *carried, *_VERDICT, LATE, *([EVENT] if chained else [])])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start bigint, n bigint")

    def load(self, key: tuple) -> None:
        self.start, self.n = self.window.get() if self.window.exists() else (None, 0)

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        if self.counted and row["kind"] not in self.counted:
            yield self._known(key, row) | {"late": False}
            return
        if self.start is None or row["ts_us"] >= self.start + self.window_us:
            self.start, self.n = row["ts_us"], 0
        self.n += 1
        verdict = {"window_start_us": self.start, "n_in_window": self.n, "limited": self.n > self.limit, "late": False}
        yield self._known(key, row) | verdict

    def save(self, key: tuple) -> None:
        if self.start is not None:
            self.window.update((self.start, self.n))

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield self._known(key, row) | {"late": True}

    def idle_at(self) -> int | None:
        return self.window.get()[0] + self.window_us if self.window.exists() else None

    def give_up(self) -> None:
        self.window.clear()

    def _known(self, key: tuple, row: dict) -> dict:
        return {n: row[n] for n in self.names} | {self.user: key[0]}


def limit_stream(
    hits: DataFrame,
    window_us: int = WINDOW_US,
    limit: int = S.RATE_LIMIT,
    delay: str = "10 seconds",
    user: str = "user_id",
) -> DataFrame:
    """(event_id, user, ts, ...) stream -> verdicts as ``rate_limit`` gives them, in time order per user.

    A hit is counted once the watermark, ``delay`` behind the newest hit, has passed it. Hits that come
    behind the watermark come out at once with ``late`` true and no verdict: let through or refuse them as suits, they
    are in no window. Other columns are handed on.
    """
    rows = timed(hits, delay)
    known = {"event_id", "ts_us", "ts", user}
    carried = [f for f in hits.schema.fields if f.name not in known]
    counter = WindowCounter(hits.schema[user], window_us, limit, carried)
    return run_ordered(rows, [user], counter)


def run_limiter(
    hits: DataFrame,
    counted_path: str,
    late_path: str,
    checkpoint: str,
    window_us: int = WINDOW_US,
    limit: int = S.RATE_LIMIT,
    delay: str = "10 seconds",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the limiter with two tables: verdicts, and the hits that came too late for one."""
    verdicts = limit_stream(hits, window_us, limit, delay)
    return write_split(verdicts, counted_path, late_path, checkpoint, trigger)
