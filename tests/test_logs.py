from __future__ import annotations

import random

from pyspark.sql import functions as F

from parchmill.operators import logs
from parchmill.sources import logs as log_source

# The layout and the fixed messages are the service's; times, places, ids and lengths are made up.
DAY = "2031-02-0"


def line(day, clock, level, place, message):
    return f"{DAY}{day} {clock} | {level:<8} | jobs:{place} - {message}"


LINES = [
    line(3, "23:10:00.250", "INFO", "run:11", "Получено сообщение для суммаризации: ID=s-900, длина текста=41"),
    line(3, "23:10:04.000", "INFO", "run:12", "Суммаризация завершена: ID=s-900"),
    line(3, "23:11:20.500", "INFO", "run:13", "Получен вопрос: ID=q-17, вопрос=Сколько, ID=zz, длина контекста=5?, длина контекста=88"),
    line(3, "23:11:21.750", "INFO", "run:14", "Ответ на вопрос подготовлен: ID=q-17"),
    line(4, "00:00:01.000", "ERROR", "loop:77", "Ошибка подключения к Kafka: timed out"),
    "  File made_up.py, line 1",
]


def test_parse_pair_and_roll_up(spark):
    rows = logs.mark_requests(logs.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")))
    got = rows.collect()
    assert [r.event for r in got] == ["summary_start", "summary_end", "question_start", "question_end", "broker_down", None]
    assert [(r.level, r.func, r.line) for r in got][4:] == [("ERROR", "loop", 77), (None, None, None)]
    assert (got[2].request_id, got[2].n_chars) == ("q-17", 88)
    paired = logs.latencies(rows)
    assert {(r.request_id, r.service, r.latency_ms, r.n_chars) for r in paired.collect()} == {
        ("s-900", "summary", 3750, 41),
        ("q-17", "question", 1250, 88),
    }
    stats = {r.service: (r.n_requests, r.min_ms, r.median_ms, r.max_ms) for r in logs.latency_stats(paired).collect()}
    assert stats == {"summary": (1, 3750, 3750, 3750), "question": (1, 1250, 1250, 1250)}
    assert {(r.level, r.n_lines) for r in logs.level_counts(rows).collect()} == {("INFO", 4), ("ERROR", 1), (None, 1)}


def test_folders_labels_and_daily_table(spark, tmp_path):
    for job, lines in (("worker", LINES[:4]), ("gateway", LINES[4:])):
        (tmp_path / job).mkdir()
        (tmp_path / job / "x.log").write_text("\n".join(lines) + "\n")
        (tmp_path / job / "x.txt").write_text("not a log\n")
    jobs = {job: str(tmp_path / job / "*.log") for job in ("worker", "gateway")}
    lines = log_source.read_logs(spark, jobs)
    assert {(r.job, r.n) for r in lines.groupBy("job").agg(F.count("*").alias("n")).collect()} == {("worker", 4), ("gateway", 2)}
    assert all(r.labels["job"] == r.job and r.file_path.endswith("x.log") for r in lines.collect())
    log_source.write_log_table(logs.parse_lines(lines), str(tmp_path / "table"))
    days = spark.read.parquet(str(tmp_path / "table")).groupBy("log_date").count().collect()
    assert {(str(r.log_date), r["count"]) for r in days} == {("2031-02-03", 4), ("2031-02-04", 1), ("None", 1)}


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES))
    rows = logs.mark_requests(logs.parse_lines(log_source.stream_logs(spark, {"worker": str(tmp_path / "in" / "*.log")})))
    query = (
        rows.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("event is not null").count() == 5


def test_running_metrics_equal_the_batch(spark, tmp_path):
    from parchmill.streaming import logs as log_streams
    from tests.test_ordered_streams import DELAY, SECOND, shuffled, stream, write_files

    rng, rows = random.Random(6), []
    for i in range(120):
        start = rng.randrange(990_000) * 1000
        kind = rng.choice(["summary", "question"])
        rows.append({"request_id": f"r{i}", "event": f"{kind}_start", "n_chars": i, "ts_us": start})
        if i % 10:
            rows.append({"request_id": f"r{i}", "event": f"{kind}_end", "n_chars": None, "ts_us": start + rng.randrange(90_000) * 1000})
    schema = "request_id string, event string, n_chars int, ts_us bigint"
    end = [{"request_id": "end", "event": "summary_start", "n_chars": 1, "ts_us": 100_000 * SECOND}]
    write_files(spark, tmp_path / "in", shuffled(rows, 1) + end, schema, 4, 1100 * SECOND)
    query = log_streams.run_log_metrics(
        stream(spark, tmp_path / "in", schema), str(tmp_path / "counts"), str(tmp_path / "open"), str(tmp_path / "cp"), 60_000, DELAY
    )
    query.awaitTermination(200)
    assert query.exception() is None
    table = spark.createDataFrame([tuple(r[c] for c in ("request_id", "event", "n_chars", "ts_us")) for r in rows], schema)
    paired = logs.latencies(table.withColumn("ts", F.timestamp_micros("ts_us")))
    names = ["service", "n_requests", "min_ms", "median_ms", "max_ms"]
    rolled = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rolled(log_streams.read_metrics(spark, str(tmp_path / "counts"))) == rolled(logs.latency_stats(paired))
    by_day = log_streams.read_metrics(spark, str(tmp_path / "counts"), "day").collect()
    assert {str(r.day) for r in by_day} == {"1970-01-01"} and sum(r.n_requests for r in by_day) == 108
    still_open = {r.request_id for r in spark.read.parquet(str(tmp_path / "open")).collect()}
    slow = {r.request_id for r in paired.filter("latency_ms is null or latency_ms > 60000").collect()}
    assert still_open == slow and len(slow) > 12


def test_stages_of_an_answer(spark):
    place = "answer:3"
    lines = [
        line(5, "10:00:00.000", "INFO", place + "1", "Перевод вопроса на английский: что"),
        line(5, "10:00:00.250", "INFO", place + "2", "Переведенный вопрос: what"),
        line(5, "10:00:00.250", "INFO", place + "3", "Перевод контекста на английский (первые 70 символов)"),
        line(5, "10:00:09.250", "INFO", place + "4", "Контекст переведен на английский (длина: 66)"),
        line(5, "10:00:10.000", "INFO", place + "5", "Получен ответ на английском: this"),
        line(5, "10:00:11.500", "INFO", place + "6", "Ответ переведен на русский: это"),
        line(5, "10:01:00.000", "INFO", place + "1", "Перевод вопроса на английский: где"),
        line(5, "10:01:01.000", "ERROR", "run:40", "Ошибка обработки сообщения: no model"),
    ]
    rows = logs.mark_requests(logs.parse_lines(spark.createDataFrame([(x, "w.log") for x in lines], "value string, file_path string")))
    assert rows.filter("event = 'message_failed'").count() == 1
    got = {r.stage: (r.n_stages, r.total_ms) for r in logs.stage_stats(logs.stage_times(rows)).collect()}
    assert got == {"question_translation": (1, 250), "context_translation": (1, 9000), "generation": (1, 750), "back_translation": (1, 1500)}
