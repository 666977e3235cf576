from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators.state import lookup_status
from parchmill.operators.summarize import summarize
from parchmill.sources import results, topics
from parchmill.streaming import worker

REQUEST = "request_id string, text string, question string, ts timestamp"


def write_parts(df, order, folder, n=4):
    """One file per time slice, so that a one-file trigger replays the table in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // n)
    for i in range(0, len(rows), step):
        df.sparkSession.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collect(spark, stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / f"{name}-out"))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


@pytest.mark.parametrize("wire", ["json", "delimited"])
def test_gateway_and_worker(spark, tmp_path, wire):
    rows = [
        ("a", "First thing. Second thing.", None, None),
        ("b", "The cat sat. Dogs ran.", "who sat", None),
        ("c", "", None, None),
        ("d", None, None, None),
        ("e", "", "who", None),
    ]
    requests = spark.createDataFrame(rows, REQUEST).withColumn("ts", F.timestamp_seconds(F.lit(100)))
    path = {k: str(tmp_path / k) for k in ("in", "state", "topic", "dead", "cp1", "cp2")}
    write_parts(requests, "request_id", path["in"], 3)

    worker.run_gateway(stream_of(spark, path["in"], requests.schema), path["state"], worker.folder_sink(path["topic"]), path["cp1"], wire, rejects=str(tmp_path / "no")).awaitTermination(120)
    latest = results.read_latest(spark, path["state"])
    assert {r.request_id: r.value for r in latest.collect()} == {"a": "processing", "b": "processing", "c": "processing"}
    refused = spark.read.parquet(str(tmp_path / "no")).collect()
    assert {r.request_id: r.error for r in refused} == {"d": S.NO_TEXT, "e": S.EXTRACT_FAILED}

    bad = spark.createDataFrame([("question", "z", b"no delimiter", 0, 1)], "topic string, key string, value binary, partition int, offset bigint")
    bad.withColumn("timestamp", F.timestamp_seconds(F.lit(0))).write.parquet(path["topic"] + "/batch=900")
    rows = topics.read_topic_folder(spark, path["topic"], 1)
    worker.run_worker(rows, path["state"], path["dead"], path["cp2"], wire).awaitTermination(120)

    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    got = {r.request_id: (r.status, r.summary) for r in lookup_status(asked, results.read_latest(spark, path["state"])).collect()}
    assert got == {
        "a": ("done", "First thing Second thing."),
        "b": ("done", "The cat sat Dogs ran."),
        "c": ("not_found", None),
    }
    dead = spark.read.schema(S.DEAD_LETTER).parquet(path["dead"]).collect()
    assert [(r.topic, bytes(r.value), r.reason) for r in dead] == [("question", b"no delimiter", "malformed frame")]

    before = sorted(results.read_latest(spark, path["state"]).select("request_id", "value").collect())
    log = results.state_log(path["state"])
    assert log.compact(spark) == 0
    assert sorted(results.read_latest(spark, path["state"]).select("request_id", "value").collect()) == before


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1, True, None)], S.STATE_ROW)
    for _ in range(2):
        results.state_log(str(tmp_path / "log")).write(rows, 7, "worker")
    assert results.read_state_log(spark, str(tmp_path / "log")).count() == 1


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame(
        [("summarize", k, b"x", 0, i, None) for i, k in enumerate("aabca")], S.TOPIC_ROW
    ).withColumn("timestamp", F.timestamp_seconds("offset"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = collect(spark, worker.distinct_deliveries(topics.read_topic_folder(spark, str(tmp_path / "in"))), tmp_path, "d")
    assert sorted(r.key for r in out.collect()) == ["a", "b", "c"]


def test_text_operators_run_on_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_parts(docs, "doc_id", str(tmp_path / "in"), 2)
    out = collect(spark, summarize(stream_of(spark, str(tmp_path / "in"), docs.schema)).select("doc_id", "summary"), tmp_path, "s")
    assert sorted(out.collect()) == sorted(summarize(docs).select("doc_id", "summary").collect())


def test_kafka_options():
    assert topics.kafka_source_options("h:9092", max_offsets_per_trigger=10) == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "summarize,question",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "10",
    }


def test_topic_folder(spark, tmp_path):
    df = spark.createDataFrame([("summarize", "a", b"x", None), ("question", "b", b"y", None)], "topic string, key string, value binary, timestamp timestamp")
    topics.append_to_topic_folder(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.topic, r.key, bytes(r.value)) for r in back.collect()) == [("question", "b", b"y"), ("summarize", "a", b"x")]


def test_questions_meet_one_file_or_are_refused(spark):
    from parchmill.plans import service

    calls = spark.sparkContext.accumulator(0)

    def reader(content):
        calls.add(1)
        return [content.decode()]

    files = spark.createDataFrame(
        [("d1/x.txt", "x.txt", b"One."), ("d2/x.txt", "x.txt", b"Two."), ("y.pdf", "y.pdf", b"Three.")],
        "path string, filename string, content binary",
    )
    asked = spark.createDataFrame(
        [("q1", "d1/x.txt", "x.txt", "one"), ("q2", "d9/x.txt", "x.txt", "one"), ("q3", "y.pdf", "y.pdf", "three")],
        "request_id string, path string, filename string, question string",
    ).withColumn("ts", F.timestamp_seconds(F.lit(5)))
    by_name = service.submit_questions(files, asked.drop("path"), pdf_reader=reader)
    assert sorted(r.request_id for r in by_name.frames.withColumnRenamed("key", "request_id").collect()) == ["q3"]
    assert sorted((r.request_id, r.error) for r in by_name.rejected.collect()) == [("q1", S.NO_FILE), ("q2", S.NO_FILE)]
    assert calls.value == 1
    by_path = service.submit_questions(files, asked, pdf_reader=reader, on="path")
    assert sorted(r.key for r in by_path.frames.collect()) == ["q1", "q3"]
    assert [r.request_id for r in by_path.rejected.collect()] == ["q2"]


def test_texts_are_refused_only_if_there_is_none(spark):
    from parchmill.plans import service

    texts = spark.createDataFrame([("a", ""), ("b", None)], "request_id string, text string")
    sent = service.submit_texts(texts.withColumn("ts", F.timestamp_seconds(F.lit(5))))
    assert [r.key for r in sent.frames.collect()] == ["a"] and [r.request_id for r in sent.rejected.collect()] == ["b"]


def test_service_in_one_batch_plan(spark):
    from parchmill.plans import service

    ts = F.timestamp_seconds(F.lit(5))
    files = spark.createDataFrame([("a.txt", b"One fish. Two fish."), ("b.doc", b"x"), ("c.txt", b"")], "filename string, content binary")
    uploads = files.withColumns({"request_id": F.concat(F.lit("s-"), "filename"), "ts": ts})
    asked = spark.createDataFrame(
        [("q1", "a.txt", "two"), ("q2", "a.txt", "zebra"), ("q3", "b.doc", "x")], "request_id string, filename string, question string"
    ).withColumn("ts", ts)
    summaries = service.submit_files(uploads)
    questions = service.submit_questions(files, asked)
    assert sorted(r.request_id for r in summaries.rejected.collect()) == ["s-b.doc", "s-c.txt"]
    assert [r.request_id for r in questions.rejected.collect()] == ["q3"]
    ids = uploads.select("request_id").unionByName(asked.select("request_id"))
    told = service.check_status(ids, service.run([summaries, questions]))
    assert {r.request_id: (r.status, r.summary, r.ok) for r in told.collect()} == {
        "s-a.txt": ("done", "One fish Two fish.", True),
        "s-b.doc": ("not_found", None, False),
        "s-c.txt": ("not_found", None, False),
        "q1": ("done", "Two fish.", True),
        "q2": ("done", S.ANSWER_NOT_FOUND, False),
        "q3": ("not_found", None, False),
    }
