"""Bot sessions, web sessions and transcripts on streams, in event-time order. The state is durable and has no expiry.

``streaming.bot`` has the whole bot, with limiter, cache and replies.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from parchmill import schemas as S
from parchmill.streaming.ordered import LATE, Ordered, run_ordered, timed

_PLACE = [T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType())]
_KIND = T.StructField("kind", T.StringType())


class BotSession(Ordered):
    """State per user: question mode and last delivered file."""

    order = ("rank", "event_id")

    def __init__(self, user: T.StructField):
        self.row = T.StructType(
            [
                *_PLACE,
                _KIND,
                T.StructField("rank", T.IntegerType()),
                T.StructField("file_key", T.LongType()),
                T.StructField("limited", T.BooleanType()),
                T.StructField("hit", T.BooleanType()),
            ]
        )
        told = [T.StructField("route", T.StringType()), T.StructField("last_file", T.LongType())]
        self.output = T.StructType([*_PLACE, user, *told, LATE])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "qa_mode boolean, last_file bigint")

    def load(self, key: tuple) -> None:
        self.qa_mode, self.last_file = self.session.get() if self.session.exists() else (False, None)

    def save(self, key: tuple) -> None:
        self.session.update((self.qa_mode, self.last_file))

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        seen_mode, seen_file = self.qa_mode, self.last_file
        if row["kind"] == "done":
            self.last_file = row["file_key"]
            return
        if row["kind"] == "enter":
            route, self.qa_mode = "enter", True
        elif row["kind"] == "exit":
            route, self.qa_mode, self.last_file = "exit", False, None
        elif row["limited"]:
            route = "rate_limited"
        elif row["hit"]:
            route = "cache_hit"
        elif row["kind"] == "file":
            route, self.qa_mode = "summarize_file", False
        elif seen_mode:
            route = "qa_no_file" if seen_file is None else "question"
        else:
            route = "summarize_text"
        yield self._told(key, row) | {"route": route, "last_file": seen_file, "late": False}

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        if row["kind"] != "done":
            yield self._told(key, row) | {"late": True}

    def _told(self, key: tuple, row: dict) -> dict:
        return {"event_id": row["event_id"], "ts_us": row["ts_us"], self.output.names[2]: key[0]}


class WebSession(Ordered):
    """State per user: upload the session is about, and the action chosen since."""

    def __init__(self, user: T.StructField):
        self.row = T.StructType([*_PLACE, _KIND, T.StructField("user_text", T.StringType())])
        told = [
            T.StructField("segment", T.LongType()),
            T.StructField("action", T.StringType()),
            T.StructField("route", T.StringType()),
        ]
        self.output = T.StructType([*_PLACE, user, *told, LATE])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "segment bigint, action string")

    def load(self, key: tuple) -> None:
        self.segment, self.action = self.session.get() if self.session.exists() else (None, None)

    def save(self, key: tuple) -> None:
        self.session.update((self.segment, self.action))

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        seen_action, kind = self.action, row["kind"]
        if kind == "upload":
            self.segment, self.action, seen_action = row["event_id"], None, None
            route = "summarize_file"
        elif kind in ("continue", "ask"):
            if self.segment is None or self.action is not None:
                route = "ignored"
            elif kind == "continue":
                route, self.action = "summarize_file", "continue"
            else:
                route, self.action = "prompt", "question"
        elif not row["user_text"]:
            route = "ignored"
        else:
            route = "question" if self.action == "question" else "summarize_text"
        yield self._told(key, row) | {"segment": self.segment, "action": seen_action, "route": route, "late": False}

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield self._told(key, row) | {"late": True}

    def _told(self, key: tuple, row: dict) -> dict:
        return {"event_id": row["event_id"], "ts_us": row["ts_us"], self.output.names[2]: key[0]}


class Transcript(Ordered):
    """State per conversation: how often the second list was emptied, and the messages in each list."""

    order = ("turn",)

    def __init__(self, conversation: T.StructField):
        shown = [
            T.StructField("turn", T.LongType()),
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("file_info", S.FILE_INFO),
            T.StructField("target", T.StringType()),
        ]
        self.row = T.StructType([_PLACE[1], *shown, T.StructField("asks", T.BooleanType())])
        numbers = [T.StructField("segment", T.LongType()), T.StructField("seq", T.LongType())]
        self.output = T.StructType([conversation, _PLACE[1], *shown, *numbers, LATE])
        self.kept = [f.name for f in shown]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.emptied = handle.getValueState("emptied", "n bigint")
        self.counts = handle.getMapState("counts", "target string", "n bigint")

    def load(self, key: tuple) -> None:
        self.n_emptied = self.emptied.get()[0] if self.emptied.exists() else 0

    def save(self, key: tuple) -> None:
        self.emptied.update((self.n_emptied,))

    def step(self, key: tuple, row: dict) -> Iterable[dict]:
        target = (row["target"],)
        after = row["target"] == "after"
        if row["type"] == "file" or row["asks"]:
            self.n_emptied += 1
            self.counts.removeKey(("after",))
        seq = (self.counts.getValue(target)[0] if self.counts.containsKey(target) else 0) + 1
        self.counts.updateValue(target, (seq,))
        shown = S.WEB_NO_SUMMARY if row["type"] == "model" and not row["text"] else row["text"]
        numbers = {"segment": self.n_emptied if after else 0, "seq": seq, "late": False}
        yield self._told(key, row) | {"text": shown} | numbers

    def late(self, key: tuple, row: dict) -> Iterable[dict]:
        yield self._told(key, row) | {"late": True}

    def _told(self, key: tuple, row: dict) -> dict:
        return {n: row[n] for n in ("ts_us", *self.kept)} | {self.output.names[0]: key[0]}


def route_bot_stream(rows: DataFrame, delay: str = "10 seconds", user: str = "user_id") -> DataFrame:
    """Stream of bot rows (event_id, user, ts, kind, file_key, limited, hit), with a ``done`` row for
    every file summary delivered -> event_id, ts_us, user, route, last_file, late."""
    ranked = rows.withColumn("rank", F.when(F.col("kind") == "done", 0).otherwise(1))
    return run_ordered(timed(ranked, delay), [user], BotSession(rows.schema[user]))


def route_web_stream(rows: DataFrame, delay: str = "10 seconds", user: str = "user_id") -> DataFrame:
    """Stream of web rows (event_id, user, ts, kind, user_text) -> event_id, ts_us, user, segment, action, route, late."""
    return run_ordered(timed(rows, delay), [user], WebSession(rows.schema[user]))


def transcript_stream(messages: DataFrame, delay: str = "10 seconds", conversation: str = "conv_id") -> DataFrame:
    """Stream of messages as ``sessions.transcript`` takes them, with ``ts`` -> the same numbers, by time and turn.

    A message behind the watermark comes out marked ``late``, with no number.
    """
    return run_ordered(timed(messages, delay), [conversation], Transcript(messages.schema[conversation]))
