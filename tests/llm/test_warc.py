from __future__ import annotations

import base64
import hashlib
import random
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import warc
from parchmill.session import shared_folder


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9))), max_size=9))
def test_loser_tree(runs):
    merged = list(warc.merge_runs([iter(sorted(run)) for run in runs]))
    assert merged == sorted(x for run in runs for x in run)


NASTY = [
    "plain",
    None,
    "",
    "ends\r\n\r\n",
    "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    "Content-Transfer-Encoding: base64\r\n\r\nx",
    "WARC/1.1\r\nWARC-Type: response\r\n\r\n",
    "\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n",
    "é😀 " * 5_000,
    "lone \r and \n and  ",
]


def written(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archives(warc.captures(pages), folder)
    return warc.read_archives(spark, folder)


def test_archives_give_back_what_was_written(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", NASTY[i % len(NASTY)]) for i in range(40)]
    rows += [(None, None, "of nobody"), (39, rows[39][1], rows[39][2]), (50, "a\r\nWARC-Type: x", "only once"), (51, "", "y")]
    rows += [(10**12, "http://far.org/", "far"), (10**15, None, "farther"), (2**63 - 1, "http://far.org/", "last"), (-5, "u", "below")]
    records = written(spark, rows).collect()
    assert len(records) == len(rows)
    payloads = {}
    for record in records:
        if record.record_type == "response":
            data = bytes(record.payload)
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert digest == record.stated_digest and len(data) == record.stated_bytes
            assert digest not in payloads
            payloads[digest] = (record.page_id, data)
    assert {data for _, data in payloads.values()} == {(html or "").encode() for _, _, html in rows}
    least = -(2**63)
    largest = {}
    for page, _, html in rows:
        largest[(html or "")] = max(largest.get(html or "", least), least if page is None else page)
    for record in records:
        page, data = payloads[record.stated_digest]
        assert (least if page is None else page) == largest[data.decode()]
        assert record.refers_to == (page if record.record_type == "revisit" else None)


def test_one_line_per_page_whatever_its_id_and_payload(spark):
    rows = [(10**k, f"http://h.org/{k % 3}", NASTY[k % len(NASTY)]) for k in range(19)] + [(2**63 - 1, "http://h.org/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    lines = warc.archive_and_index(pages, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}").collect()
    assert sorted((line.page_id, line.payload_bytes) for line in lines) == sorted((i, len((html or "").encode())) for i, _, html in rows)


def test_histories_are_globally_ordered(spark):
    rng = random.Random(4)
    rows = [(i, f"https://www.{rng.choice('abc')}.example.org/{rng.randint(0, 5)}?q={i % 2}", str(i)) for i in range(300)]
    rows += [(300 + i, "http://hot.example.org/", "same") for i in range(200)] + [(None, None, "x"), (1, rows[1][1], "1")]
    index = warc.capture_index(written(spark, rows)).repartition(5)
    merged = warc.histories(index, range_rows=60)
    got = [tuple(row) for row in merged.collect()]
    key = lambda row: tuple((v is not None, v) if v is not None else (False,) for v in row[:3])
    assert [key(row) for row in got] == sorted(key(tuple(row)) for row in index.collect())
    assert sorted(map(repr, got)) == sorted(repr(tuple(row)) for row in index.collect())


def test_url_keys(spark):
    urls = ["https://www.Example.org/A?b=1", "http://a.b.org", "no url", None, "http://x y/"]
    df = spark.createDataFrame([(url,) for url in urls], "url string")
    assert [r[0] for r in df.select(warc.url_key(df.url)).collect()] == [
        "org,example)/a?b=1", "org,b,a)/", "no url", "", "http://x y/"
    ]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(pages, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}").collect() == []
