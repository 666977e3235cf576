"""Service logs: parsing, request latencies and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import text as tx

# Line layout and the messages that mark a request's submission, start and end.
LINE = r"^(\S+ \S+) \| (\w+)\s*\| ([\w.]+):(\w+):(\d+) - (.*)$"
SUMMARY_START = "Получено сообщение для суммаризации: ID="
SUMMARY_END = "Суммаризация завершена: ID="
QUESTION_START = "Получен вопрос: ID="
QUESTION_END = "Ответ на вопрос подготовлен: ID="
FILE_SENT = ("Файл ", " отправлен на суммаризацию, ID=")
QUESTION_SENT = ("Вопрос к файлу ", " отправлен, ID=")
BAD_FRAME = "Неверный формат сообщения для вопроса: "
BROKER_DOWN = "Ошибка подключения к Kafka: "
MESSAGE_FAILED = "Ошибка обработки сообщения: "
QUESTION_TRANSLATION = "Перевод вопроса на английский: "
QUESTION_TRANSLATED = "Переведенный вопрос: "
CONTEXT_TRANSLATION = "Перевод контекста на английский (первые "
CONTEXT_TRANSLATED = "Контекст переведен на английский (длина: "
ANSWER_MADE = "Получен ответ на английском: "
ANSWER_TRANSLATED = "Ответ переведен на русский: "
TEXT_LENGTH = "длина текста="
CONTEXT_LENGTH = "длина контекста="
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"

# The lines a worker writes on its way to an answer; none of them carries an id.
STEPS = {
    "question_translation": QUESTION_TRANSLATION,
    "question_translated": QUESTION_TRANSLATED,
    "context_translation": CONTEXT_TRANSLATION,
    "context_translated": CONTEXT_TRANSLATED,
    "answer_made": ANSWER_MADE,
    "answer_translated": ANSWER_TRANSLATED,
}
# A stage is the time between two of these lines that follow each other.
STAGES = {
    "question_translation": ("question_translation", "question_translated"),
    "context_translation": ("context_translation", "context_translated"),
    "generation": ("context_translated", "answer_made"),
    "back_translation": ("answer_made", "answer_translated"),
}


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Raw lines -> ts, level, module, func, line, message.

    Lines of another layout keep only their ``value`` with NULL fields. The layout
    is matched once; the fields are then cut out at their separators.
    """
    checked = lines.withColumn("_raw", F.when(F.col(value).rlike(LINE), F.col(value)))
    stamped = checked.withColumn("_stamp", F.substring_index("_raw", " | ", 1))
    rest = F.expr("substring(_raw, length(_stamp) + 4)")
    headed = stamped.withColumn("_rest", rest).withColumn("_head", F.substring_index("_rest", " - ", 1))
    placed = headed.withColumn("_place", F.split(F.substring_index("_head", "| ", -1), ":"))
    return placed.withColumns(
        {
            "ts": F.try_to_timestamp("_stamp", F.lit(TIME_FORMAT)),
            "level": F.rtrim(F.substring_index("_head", "|", 1)),
            "module": F.get("_place", F.lit(0)),
            "func": F.get("_place", F.lit(1)),
            "line": F.get("_place", F.lit(2)).cast("int"),
            "message": F.expr("substring(_rest, length(_head) + 4)"),
        }
    ).drop("_raw", "_stamp", "_rest", "_head", "_place")


def _sent(message: Column, parts: tuple[str, str]) -> Column:
    return message.startswith(parts[0]) & message.contains(parts[1])


def mark_requests(rows: DataFrame) -> DataFrame:
    """Parsed rows with event, request_id and n_chars, NULL where a message has none."""
    message = F.col("message")
    event = (
        F.when(message.startswith(SUMMARY_START), F.lit("summary_start"))
        .when(message.startswith(SUMMARY_END), F.lit("summary_end"))
        .when(message.startswith(QUESTION_START), F.lit("question_start"))
        .when(message.startswith(QUESTION_END), F.lit("question_end"))
        .when(_sent(message, FILE_SENT), F.lit("summary_sent"))
        .when(_sent(message, QUESTION_SENT), F.lit("question_sent"))
        .when(message.startswith(BAD_FRAME), F.lit("bad_frame"))
        .when(message.startswith(BROKER_DOWN), F.lit("broker_down"))
        .when(message.startswith(MESSAGE_FAILED), F.lit("message_failed"))
    )
    for name, start in STEPS.items():
        event = event.when(message.startswith(start), F.lit(name))
    # The question in between is free text; the length is the last thing on the line.
    length = F.regexp_extract(message, rf"(?:{TEXT_LENGTH}|{CONTEXT_LENGTH})(\d+)\z", 1)
    marks = event.isin("summary_start", "summary_end", "question_start", "question_end")
    return tx.computed(
        rows,
        {
            "event": event,
            # A submission names a file first, so its id is the last thing on the line.
            "request_id": F.when(marks, F.regexp_extract(message, r"ID=([^,\s]+)", 1)).when(
                event.endswith("_sent"), F.substring_index(message, "ID=", -1)
            ),
            "n_chars": F.when(marks, F.nullif(length, F.lit("")).cast("int")),
        },
    )


def latencies(rows: DataFrame) -> DataFrame:
    """Start and end lines paired by request id: one conditional aggregation, no join."""
    at = F.unix_millis("ts")
    is_start = F.col("event").endswith("_start")
    marked = rows.filter(F.col("request_id").isNotNull() & ~F.col("event").endswith("_sent"))
    # Numbers only, so that the aggregation hashes instead of sorting its input.
    paired = marked.groupBy("request_id").agg(
        F.max(F.col("event").startswith("question")).alias("_asked"),
        F.min(F.when(is_start, at)).alias("start_ms"),
        F.max(F.when(~is_start, at)).alias("end_ms"),
        F.max("n_chars").alias("n_chars"),
    )
    return paired.select(
        "request_id",
        F.when(F.col("_asked"), "question").otherwise("summary").alias("service"),
        "start_ms",
        "end_ms",
        "n_chars",
        (F.col("end_ms") - F.col("start_ms")).alias("latency_ms"),
    )


def queue_waits(rows: DataFrame) -> DataFrame:
    """How long a request lay between its submission and the start of the work on it.

    A request without both lines is left out; of repeated lines the first submission and the
    first start count.
    """
    at = F.unix_millis("ts")
    sent = F.col("event").endswith("_sent")
    marked = rows.filter(sent | F.col("event").endswith("_start"))
    paired = marked.groupBy("request_id").agg(
        F.max(F.col("event").startswith("question")).alias("_asked"),
        F.min(F.when(sent, at)).alias("sent_ms"),
        F.min(F.when(~sent, at)).alias("start_ms"),
    )
    return paired.filter("sent_ms is not null and start_ms is not null").select(
        "request_id",
        F.when(F.col("_asked"), "question").otherwise("summary").alias("service"),
        (F.col("start_ms") - F.col("sent_ms")).alias("wait_ms"),
    )


def level_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level", "func").agg(F.count(F.lit(1)).alias("n_lines"))


def stage_times(rows: DataFrame, source: str = "file_path") -> DataFrame:
    """(source, stage, start_ms, stage_ms) of the stages of answering.

    ``rows``: marked rows. A worker works on one message at a time, so the lines of one ``source`` (a log
    file, which is rotated and so bounded) follow each other; lines of the same instant by their place in the program.
    """
    at = F.unix_millis("ts")
    steps = rows.filter(F.col("event").isin(*STEPS))
    before = Window.partitionBy(source).orderBy("ts", "line")
    seen = steps.select(
        source,
        "event",
        at.alias("at_ms"),
        F.lag("event").over(before).alias("_event"),
        F.lag(at).over(before).alias("start_ms"),
    )
    stage = F.lit(None).cast("string")
    for name, (first, last) in STAGES.items():
        stage = F.when((F.col("_event") == first) & (F.col("event") == last), F.lit(name)).otherwise(stage)
    timed = seen.withColumns({"stage": stage, "stage_ms": F.col("at_ms") - F.col("start_ms")})
    return timed.filter("stage is not null").select(source, "stage", "start_ms", "stage_ms")


def stage_stats(times: DataFrame) -> DataFrame:
    return times.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.sum("stage_ms").alias("total_ms"),
        F.min("stage_ms").alias("min_ms"),
        F.max("stage_ms").alias("max_ms"),
    )


def latency_counts(paired: DataFrame, *keys: str) -> DataFrame:
    """How many requests took how many milliseconds, by service and other keys. Counts of parts add up."""
    ended = paired.filter(F.col("latency_ms").isNotNull())
    return ended.groupBy(*keys, "service", "latency_ms").agg(F.count(F.lit(1)).alias("n"))


def latency_stats(paired: DataFrame) -> DataFrame:
    """Count, min, lower median and max per service, exact.

    Latencies are first counted per value, so the ordered pass sees one row per
    service and distinct millisecond, no matter how many requests there were.
    """
    return stats_of_counts(latency_counts(paired))


def stats_of_counts(counted: DataFrame, *keys: str) -> DataFrame:
    """``latency_stats`` from counts (service, latency_ms, n), one row per value, service and other keys."""
    upto = Window.partitionBy(*keys, "service").orderBy("latency_ms")
    everything = Window.partitionBy(*keys, "service")
    ranked = counted.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(everything)})
    return ranked.groupBy(*keys, "service").agg(
        F.max("total").alias("n_requests"),
        F.min("latency_ms").alias("min_ms"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("latency_ms"))).alias("median_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
