"""WARC archives of page captures, and their index merged into globally ordered histories.

Archives are written by Spark's text writer: records end in CR LF CR LF, which is its line
separator, so a part file is a WARC/1.1 file (gzip as a whole). They are read back by splitting
at ``RECORD_START``, which needs no whole file in memory. A response is an HTTP message; where its
message would hold that very sequence, the body is base64, so a split never falls inside a record.
Line breaks in a URL are left out of its header.

The index is merged outside memory: every task of the read-back sorts its captures into a run
and writes it; runs are dealt out by range of (URL key, timestamp, record), so that a busy URL
spreads over many ranges; each range merges its slices of all runs with a loser tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import cut_lineage

END = "\r\n\r\n"
RECORD_START = END + "WARC/1.1\r\n"
ROWS_OUT = 4096
RANGE_ROWS = 500_000  # captures merged by one task
FIRST_CAPTURE = 1_577_836_800  # 2020-01-01: page n is taken n seconds later, as pages have no time
SECONDS = 1 << 31  # after so many, the times begin anew; of equal times the page decides

# Digits of Spark's base 32 and of RFC 4648's.
_SPARK_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary ``data``: 5 bytes are 8 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.concat(*groups), _SPARK_DIGITS, _BASE32_DIGITS)


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, then path and query; '' for null.

    What is no URL with a host is its own key, trimmed and lower-cased.
    """
    plain = F.lower(F.trim(url))
    host = F.regexp_replace(F.try_parse_url(plain, F.lit("HOST")), r"^www\d*\.", "")
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    path = F.coalesce(F.nullif(F.try_parse_url(plain, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), F.try_parse_url(plain, F.lit("QUERY"))), F.lit(""))
    return F.coalesce(F.when(host != "", F.concat(labels, F.lit(")"), path, query)), plain, F.lit(""))


# --- writing ----------------------------------------------------------------------------


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: payload, digest, time, and which of equal payloads is the response.

    Of rows with equal payloads the one with the largest page_id is the response (null is
    smallest, of equal rows any one) and the others revisit it. Null html is an empty payload.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", sha1_base32(F.encode("payload", "UTF-8")))
    order = F.struct(F.col("page_id").alias("id"), "row")
    # Only keys and digests are aggregated; the largest row of a digest is found by partial maxima.
    chosen = rows.groupBy(F.col("digest").alias("_digest")).agg(
        F.max(order)["row"].alias("_row"), F.max_by("page_id", order).alias("_page_id")
    )
    is_response = F.col("row") == F.col("_row")
    return rows.join(chosen, F.col("digest") == F.col("_digest")).select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))).alias("captured"),
        F.when(is_response, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_response, F.col("_page_id")).alias("refers_to"),
    )


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, null where the value is."""
    return F.concat(F.lit(f"\r\n{name}: "), value)


def write_archives(rows: DataFrame, path: str) -> None:
    """Write a WARC record per capture below ``path``."""
    payload = F.col("payload")
    body = F.when(
        # With the empty line before it: a payload may begin like a record.
        F.contains(F.concat(F.lit(END), payload), F.lit(RECORD_START)),
        F.concat(F.lit(f"\r\nContent-Transfer-Encoding: base64{END}"), F.base64(F.encode(payload, "UTF-8"))),
    ).otherwise(F.concat(F.lit(END), payload))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), body)
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, http).otherwise(F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", F.translate("url", "\r\n", "")), F.lit("")),
        _line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("X-Payload-Length", F.octet_length(payload).cast("string")),
        F.when(
            ~is_response,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                _line("WARC-Refers-To", record_id(F.col("refers_to"))),
            ),
        ).otherwise(F.lit("\r\nContent-Type: application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


# --- reading ----------------------------------------------------------------------------


def _header(name: str) -> Column:
    """A header's value, null if there is none."""
    pattern = rf"(?:^|\r\n){name}: ([^\r\n]*)"
    return F.when(F.col("head").rlike(pattern), F.regexp_extract("head", pattern, 1))


def _page(name: str) -> Column:
    """The page that a record id names, '' for none."""
    return F.regexp_extract(_header(name), r"<urn:page:(-?\d+)>", 1)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: headers, and payloads cut out by the lengths they state."""
    lines = spark.read.option("lineSep", RECORD_START).text(path)
    split = lines.select(F.regexp_replace("value", r"\AWARC/1\.1\r\n", "").alias("record")).select(
        F.substring_index("record", END, 1).alias("head"), F.encode("record", "UTF-8").alias("bytes")
    )
    start = F.octet_length("head") + F.lit(len(END) + 1)
    block = F.substring("bytes", start, _header("Content-Length").cast("int"))
    rows = split.select(
        F.nullif(_page("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        _header("WARC-Target-URI").alias("url"),
        F.to_timestamp(_header("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        _header("WARC-Type").alias("record_type"),
        F.nullif(_page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        _header("X-Payload-Length").cast("long").alias("stated_bytes"),
        F.when(_header("WARC-Type") == "response", block).alias("block"),
    )
    http_head = F.substring_index(F.decode("block", "UTF-8"), END, 1)
    body = F.substring("block", F.octet_length(http_head) + F.lit(len(END) + 1), F.octet_length("block"))
    encoded = F.contains(http_head, F.lit("Content-Transfer-Encoding: base64"))
    payload = F.when(encoded, F.unbase64(F.decode(body, "UTF-8"))).otherwise(body)
    return rows.withColumn("payload", payload).drop("block")


# --- index ------------------------------------------------------------------------------


def capture_index(records: DataFrame) -> DataFrame:
    """A line per record. Length and digest come from the payload; a revisit states its response's."""
    return records.select(
        url_key(F.col("url")).alias("url_key"),
        "captured",
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "stated_bytes").alias("payload_bytes"),
        F.coalesce(sha1_base32(F.col("payload")), "stated_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORDER = ["url_key", "captured", "page_id"]


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs with a tree of losers: each inner node keeps the loser of its match,
    so the next winner costs one comparison a level."""
    n = len(runs)
    heads = [next(run, None) for run in runs]

    def before(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [0] * n
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    winner = winners[1] if n > 1 else 0
    while n and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        node = (winner + n) // 2
        while node:
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``index`` in global order of URL key, time and page: partition after partition, row after row.

    Null keys and times come first. Equal rows stay equal rows.
    """
    runs = cut_lineage(index.sortWithinPartitions(*ORDER).withColumn("_run", F.spark_partition_id()))
    n = max(1, -(-runs.count() // range_rows), index.sparkSession.sparkContext.defaultParallelism)
    # A file of a run may be read in several parts: each part is a sorted run of its own.
    dealt = runs.withColumn("_part", F.spark_partition_id()).repartitionByRange(n, *ORDER)
    names = index.columns
    at = [names.index(name) for name in ORDER]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[tuple, list[pa.RecordBatch]] = {}
        schema = None
        for batch in batches:
            schema = schema or batch.schema
            marks = [batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)]
            pairs = list(zip(*marks, strict=True))
            cuts = [0, *(i for i in range(1, len(pairs)) if pairs[i] != pairs[i - 1]), len(pairs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    slices.setdefault(pairs[a], []).append(batch.slice(a, b - a))
        if not slices:
            return
        held = pa.Table.from_batches([part for parts in slices.values() for part in parts])
        keys = list(zip(*(_sortable(held.column(i).to_pylist()) for i in at), range(held.num_rows), strict=True))
        ends = np.cumsum([sum(part.num_rows for part in parts) for parts in slices.values()]).tolist()
        merged = merge_runs([iter(keys[a:b]) for a, b in zip([0, *ends], ends, strict=False)])
        order = [key[-1] for key in merged]
        table = held.select(names)
        for start in range(0, len(order), ROWS_OUT):
            yield from table.take(order[start : start + ROWS_OUT]).combine_chunks().to_batches()

    return dealt.mapInArrow(merge, index.schema)


def _sortable(values: list) -> list[tuple]:
    return [(value is not None, value) if value is not None else (False,) for value in values]


def archive_and_index(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as archives below ``folder``, read them back, and give their index in order."""
    write_archives(captures(pages), folder)
    return histories(capture_index(read_archives(pages.sparkSession, folder)))
