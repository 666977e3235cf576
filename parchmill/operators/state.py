"""Result state: latest value per request, status lookup, content cache, compute-once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions import text as tx
from parchmill.operators.joins import LISTED, SALT_ABOVE, join_salted
from parchmill.session import cut_lineage


def newest_rows(state_log: DataFrame) -> DataFrame:
    """The last row written per request id, as it is. At equal times a result beats its ``processing`` mark,
    and of two results the one with the larger hash."""
    order = F.struct("ts", "state_rank", F.xxhash64("value"))
    newest = F.max_by(F.struct("value", "state_rank", "ok", "ts"), order).alias("s")
    return state_log.groupBy("request_id").agg(newest).select("request_id", "s.*")


def latest_state(state_log: DataFrame) -> DataFrame:
    """Last write per request id: request_id, value, ok, ts."""
    return newest_rows(state_log).drop("state_rank")


def look_up(requests: DataFrame, state_log: DataFrame) -> DataFrame:
    """Status of every asked id from the state log. Rows of other ids are left out before the
    reduction, so that values nobody asks for are neither moved nor compared."""
    asked = requests.select("request_id").distinct()
    return lookup_status(requests, latest_state(state_log.join(asked, "request_id", "left_semi")))


def lookup_status(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Status of every asked id. An absent or empty value is ``not_found``."""
    found = join_salted(requests, latest.select("request_id", "value", "ok"), "request_id", "left")
    value = F.col("value")
    known = value.isNotNull() & (value != "")
    return found.withColumns(
        {
            "status": F.when(~known, F.lit("not_found"))
            .when(value == "processing", F.lit("processing"))
            .otherwise(F.lit("done")),
            "summary": F.when(known & (value != "processing"), value),
            "ok": F.coalesce(known & F.col("ok"), F.lit(False)),
        }
    ).drop("value")


def build_cache(results: DataFrame) -> DataFrame:
    """(content_sha, summary, done_us, event_id, ok) -> earliest good result per content. Empty is not good.

    One small group per distinct content; copies are combined before the shuffle.
    """
    return earliest_rows(results).select("content_sha", F.col("done_us").alias("ready_us"), "summary")


def earliest_rows(results: DataFrame) -> DataFrame:
    """The earliest good row per content, as it is."""
    good = results.filter("ok AND summary <> ''")
    first = F.min_by(F.struct("summary", "done_us", "event_id", "ok"), F.struct("done_us", "event_id")).alias("s")
    return good.groupBy("content_sha").agg(first).select("content_sha", "s.*")


def merge_cache(cache: DataFrame, more: DataFrame) -> DataFrame:
    """Two caches as one: the earlier entry of each content stays."""
    both = cache.unionByName(more)
    return both.groupBy("content_sha").agg(
        F.min("ready_us").alias("ready_us"), F.min_by("summary", F.struct("ready_us", "summary")).alias("summary")
    )


def probe_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``hit``: was a summary of this content cached when the file came in?

    The cache grows with the data, so no side is forced to be broadcast. A content
    sent very often is a hot key on the file side, and is salted.
    """
    return join_salted(files, cache, "content_sha", "left").withColumn(
        "hit", F.coalesce(F.col("ts_us") >= F.col("ready_us"), F.lit(False))
    )


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files answered from the cache."""
    return probe_cache(files, cache).filter("hit").select(*files.columns)


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files that go on to be summarized."""
    return probe_cache(files, cache).filter(~F.col("hit")).select(*files.columns)


def compute_once(
    df: DataFrame, content_col: str, compute: Callable[[DataFrame], DataFrame], results: list[str]
) -> DataFrame:
    """Run ``compute`` on one copy of every distinct content and give all copies its results.

    ``compute`` gets (content_sha, content) rows. The map side keeps one copy per
    content and task, so a content that fills a third of the table reaches the
    shuffle once per task. The distinct contents are written down with their number
    of copies: a costly ``compute`` is not repeated for a lost executor's input, and
    the frequent contents are known for the way back, on which only hashes and
    results are joined.
    """
    keyed = df.withColumn("content_sha", tx.content_hash(F.col(content_col)))
    distinct = cut_lineage(
        keyed.groupBy("content_sha").agg(F.first(content_col).alias(content_col), F.count(F.lit(1)).alias("n_copies"))
    )
    computed = compute(distinct.select("content_sha", content_col)).select("content_sha", *results)
    copies = distinct.select("content_sha", "n_copies").filter(F.col("n_copies") > SALT_ABOVE)
    hot = [r["content_sha"] for r in copies.orderBy(F.desc("n_copies")).limit(LISTED).collect()]
    return join_salted(keyed.drop(content_col), computed, "content_sha", "left", hot)
