"""What a polling client sees: requests joined to results under a deadline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S


def deadline_ms(policy: S.PollPolicy) -> int:
    """The largest latency a client with this policy still observes as done."""
    looks_at = policy.attempts if policy.sleep_first else policy.attempts - 1
    return looks_at * policy.interval_ms


def outcome(
    latency_ms: Column, policy: S.PollPolicy, known: Column | None = None, has_text: Column | None = None
) -> tuple[Column, Column]:
    """(outcome, observed_ms) for a latency in whole milliseconds, NULL if no result came.

    A result is seen at the first look at or after it. A client that gives up on
    unknown ids does so at its first look. An empty result reads as an unknown id: such a
    client gives up when it comes, another one looks on until its deadline.
    """
    step = policy.interval_ms
    done = F.coalesce(latency_ms <= deadline_ms(policy), F.lit(False))
    looks = F.call_function("div", latency_ms + (step - 1), F.lit(step))
    if policy.sleep_first:
        looks = F.greatest(looks, F.lit(1).cast("bigint"))
    if has_text is not None and not policy.fails_on_unknown:
        done = done & has_text
    state = F.when(done, F.lit("done")).otherwise(F.lit("timeout"))
    if has_text is not None and policy.fails_on_unknown:
        state = F.when(done & ~has_text, F.lit("not_found")).otherwise(state)
    observed = F.when(done, looks * step).otherwise(F.lit(policy.attempts * step).cast("bigint"))
    if known is not None and policy.fails_on_unknown:
        state = F.when(~known, F.lit("not_found")).otherwise(state)
        observed = F.when(~known, F.lit(0).cast("bigint")).otherwise(observed)
    return state, observed


def web_error(state: Column) -> Column:
    """The error text of a web poll that did not end in a result."""
    return F.when(state == "not_found", F.lit(S.POLL_NOT_FOUND)).when(state == "timeout", F.lit(S.POLL_TIMEOUT))


def latencies(requests: DataFrame, results: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """(request_id, ts_us) with (request_id, done_us[, value]): add latency_ms (NULL without a result), has_text and known.

    A result written twice counts at its first time. Results that come after a
    deadline stay in ``results``; only the client's outcome says timeout. ``submitted`` (request_id, ts_us): an id is known from
    then on, or from its result on; without it all are.
    """
    value = F.col("value") if "value" in results.columns else F.lit("-")
    # Of results at one time, one with a text.
    first = results.groupBy("request_id").agg(
        F.min("done_us").alias("done_us"),
        F.max_by(F.coalesce(value, F.lit("")) != "", F.struct(-F.col("done_us"), F.coalesce(value, F.lit("")) != "")).alias("text"),
    )
    waited = F.greatest(F.col("done_us") - F.col("ts_us"), F.lit(0).cast("bigint"))
    latency = F.when(F.col("done_us").isNotNull(), F.call_function("div", waited + 999, F.lit(1000)))
    met = requests.join(first, "request_id", "left")
    known = F.lit(True)
    if submitted is not None:
        since = submitted.groupBy("request_id").agg(F.min("ts_us").alias("known_us"))
        met = met.join(since, "request_id", "left")
        known = F.coalesce(F.least("known_us", "done_us") <= F.col("ts_us"), F.lit(False))
    met = met.withColumns({"latency_ms": latency, "has_text": F.coalesce("text", F.lit(True)), "known": known})
    return met.drop("text", "known_us")


def poll(
    requests: DataFrame, results: DataFrame, policy: S.PollPolicy, submitted: DataFrame | None = None
) -> DataFrame:
    """Add the outcome and the latency one client observes."""
    state, observed = outcome(F.col("latency_ms"), policy, F.col("known"), F.col("has_text"))
    seen = latencies(requests, results, submitted).withColumns({"outcome": state, "observed_ms": observed})
    return seen.drop("known", "has_text")


def poll_as(
    requests: DataFrame,
    results: DataFrame,
    clients: dict[str, S.PollPolicy],
    submitted: DataFrame | None = None,
) -> DataFrame:
    """One row per request and client. The join runs once; the clients are arithmetic on it."""
    views = []
    for name, policy in clients.items():
        state, observed = outcome(F.col("latency_ms"), policy, F.col("known"), F.col("has_text"))
        views.append(F.struct(F.lit(name).alias("client"), state.alias("outcome"), observed.alias("observed_ms")))
    met = latencies(requests, results, submitted).select("*", F.inline(F.array(*views)))
    return met.drop("known", "has_text")
