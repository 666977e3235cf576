"""Table schemas, limits and fixed message texts shared by batch and streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEXT_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

FILE_QUESTION = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("question", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# Shape of a row read from a topic; the Kafka source delivers the same columns.
TOPIC_ROW = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Body of a JSON frame on either topic; ``text`` is the context of a question.
JSON_FRAME = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("question", T.StringType()),
    ]
)

STATE_ROW = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("state_rank", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# A file taken in: its id, where it came from, and its text or why there is none.
INTAKE_ROW = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("n_bytes", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("read_error", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

CACHE_LOG = T.StructType(
    [
        T.StructField("content_sha", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("done_us", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ok", T.BooleanType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

BOT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),  # text, file, enter, exit, done
        T.StructField("file_key", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
    ]
)

WEB_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),  # text, upload, continue, ask
    ]
)

FILE_INFO = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("type", T.StringType()),
    ]
)

TRANSCRIPT_MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),  # user, model, file
        T.StructField("text", T.StringType()),
        T.StructField("file_info", FILE_INFO),
    ]
)

TOPIC_SUMMARIZE = "summarize"
TOPIC_QUESTION = "question"

CHUNK_CHARS = 512
CONTEXT_CHARS = 3000
MIN_ANSWER_CHARS = 5
# Buckets of a keyed log: a lookup of few keys reads so small a share of it.
LOG_BUCKETS = 64
RATE_LIMIT = 5
RATE_WINDOW_S = 60
ACCEPTED_EXTENSIONS = (".txt", ".doc", ".docx", ".pdf")
EXTRACTED_EXTENSIONS = (".pdf", ".docx", ".txt")


@dataclass(frozen=True)
class GenerationConfig:
    """Length bounds of one text operator, plus the knobs only a model backend reads."""

    max_input_tokens: int
    min_tokens: int
    max_tokens: int
    prefix: str = ""
    num_beams: int = 1
    length_penalty: float = 1.0
    early_stopping: bool = True
    no_repeat_ngram_size: int = 0
    temperature: float = 1.0
    top_k: int = 50
    repetition_penalty: float = 1.0


# Generation settings of the two text services and the translator.
SUMMARY = GenerationConfig(
    max_input_tokens=1024, min_tokens=40, max_tokens=250, prefix="summarize: ", num_beams=4, length_penalty=2.0
)
ANSWER = GenerationConfig(
    max_input_tokens=1024,
    min_tokens=30,
    max_tokens=200,
    num_beams=5,
    length_penalty=2.5,
    no_repeat_ngram_size=3,
    temperature=0.8,
    top_k=50,
    repetition_penalty=1.2,
)
TRANSLATE_MAX_TOKENS = 512


@dataclass(frozen=True)
class PollPolicy:
    """How a client waits: ``attempts`` looks, ``interval_ms`` apart.

    ``sleep_first`` clients wait before the first look; the others look at once.
    ``fails_on_unknown`` clients give up as soon as the id is not known.
    """

    attempts: int
    interval_ms: int
    sleep_first: bool
    fails_on_unknown: bool


# The three waiting loops.
BOT_SUMMARY_POLL = PollPolicy(attempts=120, interval_ms=2000, sleep_first=True, fails_on_unknown=False)
BOT_ANSWER_POLL = PollPolicy(attempts=60, interval_ms=2000, sleep_first=True, fails_on_unknown=False)
WEB_POLL = PollPolicy(attempts=30, interval_ms=1000, sleep_first=False, fails_on_unknown=True)

# User-visible texts.
SUMMARY_FAILED = "Ошибка при суммаризации текста"
ANSWER_FAILED = "Ошибка при обработке вопроса"
ANSWER_NOT_FOUND = "Не удалось найти ответ на ваш вопрос в предоставленном контексте."
NO_TEXT = "the request has no text"
NO_FILE = "no file for this question"
EXTRACT_FAILED = "Не удалось извлечь текст из файла"
REPLY_LIMITED = "⏳ Вы превысили лимит: 5 запросов в минуту. Пожалуйста, подождите."
REPLY_NO_FILE = "❌ Нет загруженного файла для вопросов."
REPLY_CACHED = "✅ Результат найден в кэше:\n\n"
REPLY_DONE = "✅ Готово:\n\n"
REPLY_ANSWER = "📌 Ответ:\n\n"
REPLY_ERROR = "❌ Ошибка: "
REPLY_SUMMARY_TIMEOUT = "⚠️ Время ожидания истекло. Повторите запрос позже."
REPLY_ANSWER_TIMEOUT = "⚠️ Время ожидания истекло. Попробуй позже."
REPLY_ENTER = "Ты в режиме вопросов. Задай вопрос по документу."
REPLY_EXIT = "Вы вышли из режима вопросов."
WEB_NO_SUMMARY = "Не удалось получить ответ"
WEB_REQUEST_FAILED = "Произошла ошибка при обработке запроса. Пожалуйста, попробуйте снова."
WEB_FILE_FAILED = "Произошла ошибка при обработке файла. Пожалуйста, попробуйте снова."
WEB_CONTINUE_FAILED = "Произошла ошибка при продолжении суммаризации. Пожалуйста, попробуйте снова."
WEB_ASK_PROMPT = "Задайте вопрос по содержимому файла, и я постараюсь на него ответить."
WEB_UPLOADED = "Вами был загружен файл {} для суммаризации"
POLL_NOT_FOUND = "Запрос не найден"
POLL_TIMEOUT = "Превышено время ожидания ответа"
