from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import frames
from parchmill.operators.state import look_up
from parchmill.plans import service
from parchmill.sources import results, topics
from parchmill.sources.files import read_files, stream_files
from parchmill.streaming import files as file_streams
from parchmill.streaming import worker

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(content):
    return content.decode().split("\f")


def ocr(content):
    return ["Seen. By eye."]


FOLDER = {
    "a.txt": "One fish. Two fish.".encode(),
    "sub/b.TXT": "Привет. Мир.".encode("cp1251"),
    "c.docx": docx("Red fish.", "Blue fish."),
    "d.pdf": b"Old fish.\fNew fish.",
    "e.pdf": b" \f ",
    "broken.docx": b"no archive",
    "f.doc": b"x",
    "empty.txt": b"",
    "noext": b"x",
}
TEXTS = {
    "a.txt": "One fish. Two fish.",
    "b.TXT": "Привет. Мир.",
    "c.docx": "Red fish.\nBlue fish.",
    "d.pdf": "Old fish.New fish.",
    "e.pdf": "Seen. By eye.",
}


def fill(folder, names, start=0):
    for i, name in enumerate(names):
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(FOLDER[name])
        os.utime(path, (1_000_000 + start + i, 1_000_000 + start + i))


def run_files(spark, tmp_path, checkpoint):
    query = file_streams.run_file_gateway(
        stream_files(spark, str(tmp_path / "in"), 4), str(tmp_path / "intake"), str(tmp_path / "state"),
        worker.folder_sink(str(tmp_path / "topic")), str(tmp_path / "no"), str(tmp_path / checkpoint), pdf, ocr,
    )
    query.awaitTermination(120)
    assert query.exception() is None


def ids(spark, tmp_path):
    return {r.filename: r.request_id for r in file_streams.read_intake(spark, str(tmp_path / "intake")).collect()}


def test_a_folder_of_all_formats(spark, tmp_path):
    names = list(FOLDER)
    fill(tmp_path / "in", names[:5])
    run_files(spark, tmp_path, "cp")
    fill(tmp_path / "in", names[5:], 100)
    run_files(spark, tmp_path, "cp")

    taken = {r.filename: r for r in file_streams.read_intake(spark, str(tmp_path / "intake")).collect()}
    assert {n: r.text for n, r in taken.items() if r.error is None} == TEXTS
    # The source does not list empty files.
    assert len(taken) == len(FOLDER) - 1 == len({r.request_id for r in taken.values()})
    refused = spark.read.parquet(str(tmp_path / "no")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in refused} == {(n, S.EXTRACT_FAILED) for n in ("broken.docx", "f.doc", "noext")}

    rows = topics.read_topic_folder(spark, str(tmp_path / "topic"))
    query = worker.run_worker(rows, str(tmp_path / "state"), str(tmp_path / "dead"), str(tmp_path / "cp2"))
    query.awaitTermination(120)
    asked = spark.createDataFrame([(r.filename, r.request_id) for r in taken.values()], "filename string, request_id string")
    told = {r.filename: r.status for r in look_up(asked, results.read_state_log(spark, str(tmp_path / "state"))).collect()}
    assert told == {n: "done" if n in TEXTS else "not_found" for n in taken}

    # The batch form finds the same ids and texts.
    batch = service.take_in(read_files(spark, str(tmp_path / "in")), pdf, ocr)
    assert {r.filename: (r.request_id, r.text) for r in batch.collect()} == {n: (r.request_id, r.text) for n, r in taken.items()}


def test_a_replay_gives_the_same_ids(spark, tmp_path):
    fill(tmp_path / "in", list(FOLDER))
    run_files(spark, tmp_path, "cp1")
    first, n_state = ids(spark, tmp_path), results.read_state_log(spark, str(tmp_path / "state")).count()
    # Another checkpoint: every batch is worked off once more.
    run_files(spark, tmp_path, "cp2")
    assert ids(spark, tmp_path) == first
    assert results.read_state_log(spark, str(tmp_path / "state")).count() == n_state == len(TEXTS)
    topic = spark.read.parquet(str(tmp_path / "topic"))
    assert topic.count() == len(TEXTS) and {r.key for r in topic.collect()} == {first[n] for n in TEXTS}


def test_questions_meet_files_on_streams(spark, tmp_path):
    fill(tmp_path / "in", list(FOLDER))
    run_files(spark, tmp_path, "cp")
    taken = file_streams.read_intake(spark, str(tmp_path / "intake"))
    paths = {r.filename: r.path for r in taken.collect()}
    asked = [
        ("q1", paths["a.txt"], "two", -30), ("q2", paths["a.txt"], "one", 60), ("q3", paths["d.pdf"], "new", 0),
        ("q4", paths["f.doc"], "x", 5), ("q5", "nowhere", "x", 10), ("q6", paths["c.docx"], "blue", 90),
    ]
    schema = "request_id string, path string, question string, ts timestamp"
    later = ("end", "none", "x", 90_000)

    def write(rows):
        df = spark.createDataFrame(rows, "request_id string, path string, question string, t int")
        df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000)).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
        return df

    questions = write(asked[:3]).unionByName(write(asked[3:]))
    write([later])
    end = spark.createDataFrame([("e", "p", "p", "", 0, "", None, "x")], "request_id string, path string, filename string, ext string, n_bytes int, text string, read_error string, error string")
    end.withColumn("ts", F.timestamp_seconds(F.lit(1_200_000))).coalesce(1).write.parquet(str(tmp_path / "intake/writer=files/batch=900"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asked"))
    pairs = file_streams.pair_stream(file_streams.stream_intake(spark, str(tmp_path / "intake"), 1), stream, delay="1 minute")
    query = file_streams.run_question_gateway(
        pairs, str(tmp_path / "qstate"), worker.folder_sink(str(tmp_path / "qtopic")), str(tmp_path / "qno"), str(tmp_path / "qcp")
    )
    query.awaitTermination(200)
    assert query.exception() is None

    batch = service.submit_questions(read_files(spark, str(tmp_path / "in")), questions, pdf, ocr, on="path")
    parsed = lambda rows: {(r.request_id, r.text, r.question) for r in frames.parse_frames(rows).collect()}
    got = spark.read.parquet(str(tmp_path / "qtopic"))
    assert parsed(got) == parsed(batch.frames)
    refused = {(r.request_id, r.error) for r in spark.read.parquet(str(tmp_path / "qno")).collect()}
    assert refused - {("end", S.NO_FILE)} == {(r.request_id, r.error) for r in batch.rejected.collect()}
    state = {r.request_id for r in results.read_state_log(spark, str(tmp_path / "qstate")).collect()}
    assert state == {r.request_id for r in batch.state.collect()} == {"q1", "q2", "q3", "q6"}
