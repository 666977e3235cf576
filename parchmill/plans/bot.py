"""The whole bot flow: limiter, file cache, session routing, outcomes, replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import polling, sessions
from parchmill.operators.limits import WINDOW_US
from parchmill.operators.slices import HOT_ROWS, Slices, find_slices
from parchmill.session import cut_lineage


@dataclass(frozen=True)
class BotRun:
    events: DataFrame
    counted: DataFrame
    slices: Slices

    def messages(self) -> DataFrame:
        return sessions.add_cache_hits(self.counted, F.col("body"))

    def routes(self) -> DataFrame:
        buttons = self.events.filter(F.col("kind").isin("enter", "exit"))
        return sessions.route_bot(self.messages(), buttons, self.slices)


def start(
    events: DataFrame,
    results: DataFrame,
    window_us: int = WINDOW_US,
    limit: int = S.RATE_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> BotRun:
    """Count the messages once. The cache, the routing and the completions all read the
    verdicts, so they are written down instead of being worked out per reader.

    ``events``: event_id, user_id, ts_us, kind, file_key, content_sha. ``results``: what the service made of
    them, see ``sessions.attach_results``.
    """
    slices = find_slices(events, "user_id", "ts_us", hot_rows)
    known = sessions.attach_results(events, results)
    counted = cut_lineage(sessions.count_messages(known, window_us, limit, slices))
    return BotRun(events, counted, slices)


def outcomes(routes: DataFrame) -> DataFrame:
    """Routes with what the bot saw: summaries and answers have their own deadlines. A refused file or
    question is known at once; a text is never refused."""
    summary_state, summary_ms = polling.outcome(F.col("latency_ms"), sessions.SERVICES["summary"])
    answer_state, answer_ms = polling.outcome(F.col("answer_ms"), sessions.SERVICES["question"])
    asked = F.col("route") == "question"
    waits = F.col("route").isin(*sessions.WAITING)
    error = F.when(asked, F.col("answer_error")).when(F.col("route") == "summarize_file", F.col("error"))
    seen = routes.withColumn("error", error)
    refused = F.col("error").isNotNull()
    return seen.withColumns(
        {
            "outcome": F.when(refused, "error").when(waits, F.when(asked, answer_state).otherwise(summary_state)),
            "observed_ms": F.when(refused, F.lit(0).cast("bigint")).when(
                waits, F.when(asked, answer_ms).otherwise(summary_ms)
            ),
        }
    )


def replies(routes: DataFrame) -> DataFrame:
    """Routes with the message each user gets."""
    seen = outcomes(routes)
    body = F.when(F.col("route") == "question", F.col("answer")).otherwise(F.coalesce("cached", "body"))
    return seen.withColumn("reply", sessions.reply_text(F.col("route"), F.col("outcome"), body, F.col("error")))
