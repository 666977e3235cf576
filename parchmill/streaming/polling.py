"""Deadlines on streams: a timer per waiting client, in event-time order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from parchmill import schemas as S
from parchmill.operators import polling
from parchmill.streaming.ordered import LATE, Ordered, run_ordered, timed

# At one instant an id is known and a result there before a client asks or gives up.
# Of two results one with a text comes first.
RANKS = {"submitted": 0, "result": 1, "empty": 2, "deadline": 3, "poll": 4}
KEEP_US = 86_400 * 1_000_000

_ROW = T.StructType(
    [
        T.StructField("ts_us", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("has_text", T.BooleanType()),
        T.StructField("client", T.StringType()),
        T.StructField("asked_us", T.LongType()),
    ]
)
_OUTPUT = [
    T.StructField("ts_us", T.LongType()),
    T.StructField("client", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("observed_ms", T.LongType()),
    LATE,
]


class Waiting(Ordered):
    """State per request: since when it is known, its first result, and the clients that still look.

    It is given up a day after the last of these. Outcomes: ``done``, ``timeout``, ``not_found`` as in the batch
    form; ``late_result`` (no client) for a result that comes when all who asked have given up.
    """

    order = ("rank", "client", "asked_us")

    def __init__(self, request_id: T.StructField, clients: dict[str, S.PollPolicy], all_known: bool):
        self.clients, self.all_known = clients, all_known
        self.row, self.output = _ROW, T.StructType([request_id, *_OUTPUT])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "request", "known boolean, done_us bigint, has_text boolean, n_asked bigint, last_us bigint"
        )
        self.looking = handle.getListState("looking", "client string, asked_us bigint")

    def load(self, key: tuple) -> None:
        stored = self.state.get() if self.state.exists() else (False, None, None, 0, 0)
        self.known, self.done_us, self.has_text, self.n_asked, self.last_us = stored
        self.open_polls = [tuple(p) for p in self.looking.get()] if self.looking.exists() else []

    def save(self, key: tuple) -> None:
        self.state.update((self.known, self.done_us, self.has_text, self.n_asked, self.last_us))
        if self.open_polls:
            self.looking.put(self.open_polls)
        else:
            self.looking.clear()

    def idle_at(self) -> int | None:
        return self.state.get()[4] + KEEP_US if self.state.exists() else None

    def give_up(self) -> None:
        self.state.clear()
        self.looking.clear()

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        self.last_us = row["ts_us"]
        if row["kind"] == "submitted":
            self.known = True
        elif row["kind"] == "result":
            yield from self._result(key, row)
        elif row["kind"] == "poll":
            self.n_asked += 1
            for client, policy in self.clients.items():
                yield from self._ask(key, client, policy, row["ts_us"])
        elif (row["client"], row["asked_us"]) in self.open_polls:
            self.open_polls.remove((row["client"], row["asked_us"]))
            policy = self.clients[row["client"]]
            yield self._told(key, row["asked_us"], row["client"], "timeout", policy.attempts * policy.interval_ms)

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] == "poll":
            for client in self.clients:
                yield self._told(key, row["ts_us"], client, None, None) | {"late": True}
        elif row["kind"] == "result":
            yield self._told(key, row["ts_us"], None, "late_result", None) | {"late": True}

    def _result(self, key: tuple, row: dict) -> Iterable[dict]:
        if self.done_us is not None:
            return
        self.done_us, self.has_text = row["ts_us"], row["has_text"]
        if self.n_asked and not self.open_polls:
            yield self._told(key, row["ts_us"], None, "late_result", None)
        looking, self.open_polls = self.open_polls, []
        for client, asked_us in looking:
            yield from self._see(key, client, self.clients[client], asked_us)

    def _ask(self, key: tuple, client: str, policy: S.PollPolicy, now_us: int) -> Iterable[dict]:
        if self.done_us is not None:
            yield from self._see(key, client, policy, now_us)
        elif policy.fails_on_unknown and not (self.all_known or self.known):
            yield self._told(key, now_us, client, "not_found", 0)
        else:
            self._wait(client, policy, now_us)

    def _see(self, key: tuple, client: str, policy: S.PollPolicy, asked_us: int) -> Iterable[dict]:
        """A client learns of the result, which is there in time."""
        latency_ms = -(-max(0, self.done_us - asked_us) // 1000)
        if not self.has_text and not policy.fails_on_unknown:
            self._wait(client, policy, asked_us)  # an empty result is none for it
            return
        looks = max(-(-latency_ms // policy.interval_ms), 1 if policy.sleep_first else 0)
        yield self._told(key, asked_us, client, "done" if self.has_text else "not_found", looks * policy.interval_ms)

    def _wait(self, client: str, policy: S.PollPolicy, asked_us: int) -> None:
        self.open_polls.append((client, asked_us))
        until = asked_us + polling.deadline_ms(policy) * 1000
        self.hold({"ts_us": max(until, self.last_us), "rank": RANKS["deadline"], "kind": "deadline", "client": client, "asked_us": asked_us})

    def _told(self, key: tuple, asked_us: int, client: str | None, outcome: str | None, observed_ms: int | None) -> dict:
        told = {"ts_us": asked_us, "client": client, "outcome": outcome, "observed_ms": observed_ms, "late": False}
        return told | {self.output.names[0]: key[0]}


def poll_clients_stream(
    requests: DataFrame,
    results: DataFrame,
    clients: dict[str, S.PollPolicy],
    submitted: DataFrame | None = None,
    delay: str = "10 seconds",
) -> DataFrame:
    """Streams of looks that begin (request_id, ts) and of results (request_id, done_ts and, if there are empty ones,
    value) -> (request_id, ts_us, client, outcome, observed_ms, late), one row per request and client.

    The earliest result by its time counts, whatever order results come in. ``submitted`` (request_id, ts):
    ids are known from then on, or from their result on; without it all are known. A client's timeout comes out when the watermark
    passes its deadline; a result after that comes out as ``late_result``, and whoever keeps the state log has
    it there. Rows behind the watermark are marked ``late`` and have no outcome.
    """
    has_text = F.coalesce(F.col("value") != "", F.lit(False)) if "value" in results.columns else F.lit(True)

    def rows(stream: DataFrame, kind: str, ts: str) -> DataFrame:
        text = has_text if kind == "result" else F.lit(None).cast("boolean")
        rank = F.when(text, RANKS["result"]).otherwise(RANKS["empty"]) if kind == "result" else F.lit(RANKS[kind])
        return stream.select(
            "request_id", F.col(ts).alias("ts"), F.lit(kind).alias("kind"), rank.alias("rank"),
            text.alias("has_text"), F.lit(None).cast("string").alias("client"), F.lit(None).cast("bigint").alias("asked_us"),
        )

    union = rows(requests, "poll", "ts").unionByName(rows(results, "result", "done_ts"))
    if submitted is not None:
        union = union.unionByName(rows(submitted, "submitted", "ts"))
    processor = Waiting(requests.schema["request_id"], clients, submitted is None)
    return run_ordered(timed(union, delay), ["request_id"], processor)


def poll_stream(
    requests: DataFrame,
    results: DataFrame,
    policy: S.PollPolicy,
    delay: str = "10 seconds",
    submitted: DataFrame | None = None,
) -> DataFrame:
    """As ``poll_clients_stream`` for one client."""
    return poll_clients_stream(requests, results, {"client": policy}, submitted, delay).drop("client")
