"""The whole bot on a stream: events and results in, replies out.

Four steps in event-time order, one after the other in one query:

1. by event: results find the event they belong to, and the moment the bot sees them;
2. by user: the limiter counts texts and files;
3. by content: files are looked up among the results seen before, in any user's chat;
4. by user: question mode, last file, what waits for a result, and the replies.

Each step works on a row when the watermark has passed it and hands it on in the same micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from parchmill import schemas as S
from parchmill.operators import polling
from parchmill.operators.limits import WINDOW_US
from parchmill.operators.sessions import SERVICES, WAITING
from parchmill.streaming.limiter import WindowCounter
from parchmill.streaming.ordered import EVENT, LATE, Ordered, run_ordered, timed

# At one instant results are seen before what users send; a refused upload is known after it was sent, and
# waiting ends last.
RANKS = {"seen": 0, "event": 1, "refused": 2, "deadline": 3}
MESSAGES = ("text", "file")

_USER = T.StructField("user_id", T.LongType())
_CARRIED = [
    T.StructField("rank", T.IntegerType()),
    T.StructField("kind", T.StringType()),  # text, file, enter, exit, seen
    T.StructField("file_key", T.LongType()),
    T.StructField("content_sha", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("sent_us", T.LongType()),
]
_PLACE = [T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType())]


class Meeting(Ordered):
    """State per event: the event until its last deadline, and results stamped before it.

    Events go on as they are. A result goes on as ``seen`` at the first look at or after it, or right after the
    event if it is a refusal; an empty one, and one after the deadline, does not.
    """

    order = ("rank", "service")

    def __init__(self) -> None:
        self.row = T.StructType([_PLACE[1], _USER, *_CARRIED])
        self.output = T.StructType([*_PLACE, _USER, *_CARRIED, LATE, EVENT])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", T.StructType([_PLACE[1], _USER, *_CARRIED]))
        self.early = handle.getListState("early", T.StructType([_PLACE[1], _USER, *_CARRIED]))

    def load(self, key: tuple) -> None:
        names = self.row.names
        self.event = dict(zip(names, self.sent.get())) if self.sent.exists() else None
        self.results = [dict(zip(names, r)) for r in self.early.get()] if self.early.exists() else []

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] == "result":
            if self.event is None:
                self.results.append(row)
            else:
                yield from self._seen(key, row)
        else:
            self.event = row
            yield row | {"event_id": key[0], "sent_us": row["ts_us"], "late": False}
            for result in self.results:
                yield from self._seen(key, result)
            self.results = []

    def save(self, key: tuple) -> None:
        names = self.row.names
        if self.event is not None:
            self.sent.update(tuple(self.event.get(n) for n in names))
        if self.results:
            self.early.put([tuple(r.get(n) for n in names) for r in self.results])
        else:
            self.early.clear()

    def idle_at(self) -> int | None:
        longest = max(polling.deadline_ms(p) for p in SERVICES.values()) * 1000
        if self.sent.exists():
            return self.sent.get()[0] + longest
        return max(r[0] for r in self.early.get()) + longest if self.early.exists() else None

    def give_up(self) -> None:
        self.sent.clear()
        self.early.clear()

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] != "result":
            yield row | {"event_id": key[0], "sent_us": row["ts_us"], "late": True}

    def _seen(self, key: tuple, result: dict) -> Iterable[dict]:
        event, policy = self.event, SERVICES[result["service"]]
        known = {"event_id": key[0], "sent_us": event["ts_us"], "late": False, "kind": "seen"}
        known |= {n: event[n] for n in ("user_id", "file_key", "content_sha")}
        known |= {n: result[n] for n in ("service", "body", "error")}
        if result["error"] is not None:
            yield known | {"ts_us": event["ts_us"], "rank": RANKS["refused"]}
        elif result["body"]:
            latency_ms = -(-max(0, result["ts_us"] - event["ts_us"]) // 1000)
            if latency_ms <= polling.deadline_ms(policy):
                looks = max(-(-latency_ms // policy.interval_ms), 1 if policy.sleep_first else 0)
                yield known | {"ts_us": event["ts_us"] + looks * policy.interval_ms * 1000, "rank": RANKS["seen"]}


_COUNTED = T.StructField("limited", T.BooleanType())
_LOOKED_UP = [T.StructField("hit", T.BooleanType()), T.StructField("cached", T.StringType())]


class Lookup(Ordered):
    """State per content: the earliest summary seen of it, for ever, and the files let through that wait for one."""

    order = ("rank", "event_id")
    trusting = True

    def __init__(self) -> None:
        self.row = T.StructType([*_PLACE, _USER, *_CARRIED, _COUNTED])
        self.output = T.StructType([*_PLACE, _USER, *_CARRIED, _COUNTED, *_LOOKED_UP, LATE, EVENT])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cached = handle.getValueState("cached", "summary string")
        self.passed = handle.getMapState("passed", "event_id bigint", "ts_us bigint")

    def passes(self, row: Row) -> bool:
        return row["content_sha"] is None

    def load(self, key: tuple) -> None:
        self.summary = self.cached.get()[0] if self.cached.exists() else None

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        event_id = (row["event_id"],)
        if row["kind"] == "deadline":
            if self.passed.containsKey(event_id):
                self.passed.removeKey(event_id)
            return
        hit = False
        if row["kind"] == "seen":
            if row["error"] is None and self.summary is None and self.passed.containsKey(event_id):
                self.summary = row["body"]
                self.cached.update((self.summary,))
        elif not row["limited"]:
            hit = self.summary is not None
            if not hit:
                self.passed.updateValue(event_id, (row["ts_us"],))
                self.hold(self._end(row))
        yield row | {"hit": hit, "cached": self.summary if hit else None, "late": False}

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield row | {"hit": False}

    def _end(self, row: dict) -> dict:
        until = row["ts_us"] + polling.deadline_ms(SERVICES["summary"]) * 1000
        return {"event_id": row["event_id"], "ts_us": until, "rank": RANKS["deadline"], "kind": "deadline"}


class Chat(Ordered):
    """State per user: question mode, last delivered file, and the messages that wait for a result."""

    order = ("rank", "event_id")
    trusting = True

    def __init__(self) -> None:
        self.row = T.StructType([*_PLACE, *_CARRIED, _COUNTED, *_LOOKED_UP])
        self.output = T.StructType(
            [
                *_PLACE,
                _USER,
                T.StructField("route", T.StringType()),
                T.StructField("last_file", T.LongType()),
                T.StructField("outcome", T.StringType()),
                T.StructField("observed_ms", T.LongType()),
                T.StructField("reply", T.StringType()),
                LATE,
            ]
        )

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "asking boolean, last_file bigint")
        self.waits = handle.getMapState("waits", "event_id bigint", "route string, ts_us bigint, last_file bigint")

    def load(self, key: tuple) -> None:
        self.asking, self.last_file = self.session.get() if self.session.exists() else (False, None)

    def save(self, key: tuple) -> None:
        self.session.update((self.asking, self.last_file))

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] in ("seen", "deadline"):
            yield from self._end(key, row)
            return
        seen_file, kind = self.last_file, row["kind"]
        if kind == "enter":
            route, self.asking = "enter", True
        elif kind == "exit":
            route, self.asking, self.last_file = "exit", False, None
        elif row["limited"]:
            route = "rate_limited"
        elif row["hit"]:
            route = "cache_hit"
        elif kind == "file":
            route, self.asking = "summarize_file", False
        elif self.asking:
            route = "question" if seen_file is not None else "qa_no_file"
        else:
            route = "summarize_text"
        if route in WAITING:
            self.waits.updateValue((row["event_id"],), (route, row["ts_us"], seen_file))
            until = row["ts_us"] + polling.deadline_ms(SERVICES[WAITING[route]]) * 1000
            self.hold({"event_id": row["event_id"], "ts_us": until, "rank": RANKS["deadline"], "kind": "deadline"})
        else:
            at_once = {
                "rate_limited": S.REPLY_LIMITED,
                "qa_no_file": S.REPLY_NO_FILE,
                "enter": S.REPLY_ENTER,
                "exit": S.REPLY_EXIT,
            }
            reply = S.REPLY_CACHED + row["cached"] if route == "cache_hit" else at_once[route]
            yield self._told(key, row["event_id"], row["ts_us"], route, seen_file, reply=reply)

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield self._told(key, row["event_id"], row["ts_us"], "late", None) | {"late": True}

    def _end(self, key: tuple, row: dict) -> Iterable[dict]:
        """The wait for a result is over: it is seen, was refused, or does not come in time."""
        event = (row["event_id"],)
        if not self.waits.containsKey(event):
            return
        route, sent_us, seen_file = self.waits.getValue(event)
        if row["kind"] == "seen" and (row["service"] != WAITING[route] or row["error"] and route == "summarize_text"):
            return
        self.waits.removeKey(event)
        policy = SERVICES[WAITING[route]]
        if row["kind"] == "deadline":
            outcome, observed = "timeout", policy.attempts * policy.interval_ms
            reply = S.REPLY_ANSWER_TIMEOUT if route == "question" else S.REPLY_SUMMARY_TIMEOUT
        elif row["error"] is not None:
            outcome, observed, reply = "error", 0, S.REPLY_ERROR + row["error"]
        else:
            outcome, observed = "done", (row["ts_us"] - sent_us) // 1000
            reply = (S.REPLY_ANSWER if route == "question" else S.REPLY_DONE) + row["body"]
            if route == "summarize_file":
                self.last_file = row["file_key"]
        yield self._told(key, row["event_id"], sent_us, route, seen_file, outcome, observed, reply)

    def _told(
        self,
        key: tuple,
        event_id: int,
        ts_us: int,
        route: str,
        last_file: int | None,
        outcome: str | None = None,
        observed_ms: int | None = None,
        reply: str | None = None,
    ) -> dict:
        return {
            "event_id": event_id,
            "user_id": key[0],
            "ts_us": ts_us,
            "route": route,
            "last_file": last_file,
            "outcome": outcome,
            "observed_ms": observed_ms,
            "reply": reply,
            "late": False,
        }


def reply_stream(
    events: DataFrame,
    results: DataFrame,
    window_us: int = WINDOW_US,
    limit: int = S.RATE_LIMIT,
    delay: str = "10 seconds",
) -> DataFrame:
    """Streams of events (event_id, user_id, ts, kind, file_key, content_sha) and of results (event_id,
    service, ts, body, error) -> one row per event with its route and reply, as ``plans.bot`` has them.

    What waits for a result comes out when the result is seen, or when the watermark passes its deadline. A result
    whose event never comes is dropped after the longest deadline. Events behind the watermark come
    out with route ``late`` and no reply.
    """
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in [_USER, *_CARRIED]}
    named = ["event_id", "ts", *nothing]

    def shaped(rows: DataFrame, rank: int, **more) -> DataFrame:
        known = {n: F.col(n) for n in named if n in rows.columns}
        values = nothing | known | {"rank": F.lit(rank)} | more
        return rows.select([values[n].alias(n) for n in named])

    sent = shaped(events, RANKS["event"])
    done = shaped(results, RANKS["seen"], kind=F.lit("result"))
    met = run_ordered(timed(sent.unionByName(done), delay), ["event_id"], Meeting())
    counter = WindowCounter(_USER, window_us, limit, _CARRIED, MESSAGES, chained=True)
    counted = run_ordered(met, ["user_id"], counter).drop("window_start_us", "n_in_window")
    # What has no content goes through under keys of its own.
    place = F.coalesce("content_sha", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    looked_up = run_ordered(counted.withColumn("place", place), ["place"], Lookup())
    return run_ordered(looked_up, ["user_id"], Chat())
