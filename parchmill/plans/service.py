"""The request service on tables: submit, process, look up.

Extracted texts are written once; states, frames and refusals are read from there, so a file
is opened once whatever is made of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators import extract, frames, state
from parchmill.operators.answer import answer
from parchmill.operators.backends import CutterFactory, ModelFactory
from parchmill.operators.summarize import summarize
from parchmill.operators.translate import Translator
from parchmill.session import cut_lineage


@dataclass(frozen=True)
class Models:
    """Plug-ins; the native operators are used where there is none."""

    summarize: ModelFactory | None = None
    answer: ModelFactory | None = None
    to_model: Translator | None = None
    from_model: Translator | None = None
    cutter: CutterFactory | None = None


@dataclass(frozen=True)
class Submission:
    """What intake makes of requests: state rows, topic rows, and the refused ones."""

    state: DataFrame
    frames: DataFrame
    rejected: DataFrame | None = None


def submit_texts(requests: DataFrame, wire: str = "json") -> Submission:
    """(request_id, text, ts). An empty text is a text; without one a request is refused."""
    taken = requests.filter(F.col("text").isNotNull())
    refused = requests.filter(F.col("text").isNull()).withColumn("error", F.lit(S.NO_TEXT))
    return Submission(frames.processing_rows(taken), frames.summarize_frames(taken, wire), refused)


def submit_files(
    files: DataFrame,
    pdf_reader: extract.PartReader | None = None,
    ocr_reader: extract.PartReader | None = None,
    wire: str = "json",
) -> Submission:
    """(request_id, filename, content, ts)"""
    texts = cut_lineage(extract.extract_text(files, pdf_reader, ocr_reader))
    taken = extract.accepted_requests(texts)
    return Submission(
        frames.processing_rows(taken), frames.summarize_frames(taken, wire), extract.rejected_requests(texts)
    )


def identify(files: DataFrame) -> DataFrame:
    """(path, filename, content, modified) with its request_id and ts: a file that is read again gets
    the same id, a changed file another one."""
    n_bytes = F.octet_length("content")
    request_id = tx.stable_id(F.col("path"), F.unix_micros("modified"), n_bytes)
    return files.withColumns({"request_id": request_id, "n_bytes": n_bytes, "ts": F.col("modified")})


def take_in(
    files: DataFrame,
    pdf_reader: extract.PartReader | None = None,
    ocr_reader: extract.PartReader | None = None,
    docx_reader: extract.PartReader = extract.read_docx_paragraphs,
) -> DataFrame:
    """Files as rows of the intake table: id, where from, and the text or why there is none. Write
    it once and go on from there; every file is opened once."""
    texts = extract.extract_text(identify(files), pdf_reader, ocr_reader, docx_reader)
    return texts.select("request_id", "path", "filename", "ext", "n_bytes", "text", "read_error", "error", "ts")


def submit_taken(taken: DataFrame, wire: str = "json") -> Submission:
    """Rows of the intake table as summary requests."""
    good = extract.accepted_requests(taken)
    refused = extract.rejected_requests(taken).select("request_id", "path", "error", "ts")
    return Submission(frames.processing_rows(good), frames.summarize_frames(good, wire), refused)


def submit_questions(
    files: DataFrame,
    questions: DataFrame,
    pdf_reader: extract.PartReader | None = None,
    ocr_reader: extract.PartReader | None = None,
    wire: str = "json",
    on: str = "filename",
) -> Submission:
    """(filename, content) and (request_id, filename, question, ts), paired by ``on``.

    A file is read once, however many questions it gets. File names need not be unique where
    files come from several folders: pair such by a path or upload id that both sides have. Two
    files under one key are refused with the questions about them, as is a question without a file.
    """
    texts = extract.extract_text(files, pdf_reader, ocr_reader)
    if on != "filename":
        questions = questions.drop("filename")
    texts = cut_lineage(texts)
    several = texts.groupBy(on).count().filter("count > 1").select(on)
    asked = cut_lineage(frames.pair_questions(texts.join(several, on, "left_anti"), questions, on))
    taken = extract.accepted_requests(asked)
    lost = questions.join(asked.select("request_id"), "request_id", "left_anti")
    refused = extract.rejected_requests(asked).select("request_id", on, "error")
    refused = refused.unionByName(lost.select("request_id", on, F.lit(S.NO_FILE).alias("error")))
    return Submission(frames.processing_rows(taken), frames.question_frames(taken, wire), refused)


def process(parsed: DataFrame, models: Models = Models()) -> DataFrame:
    """Parsed frames -> state rows with the results."""

    def rows(done: DataFrame, column: str) -> DataFrame:
        return done.select(
            "request_id", F.col(column).alias("value"), F.lit(1).alias("state_rank"), "ok", F.col("timestamp").alias("ts")
        )

    summaries = summarize(frames.good_frames(parsed, S.TOPIC_SUMMARIZE), model=models.summarize, cutter=models.cutter)
    answers = answer(
        frames.good_frames(parsed, S.TOPIC_QUESTION),
        model=models.answer,
        to_model=models.to_model,
        from_model=models.from_model,
        cutter=models.cutter,
    )
    return rows(summaries, "summary").unionByName(rows(answers, "answer"))


def run(submissions: list[Submission], wire: str = "json", models: Models = Models()) -> DataFrame:
    """State log of the submissions after all their frames were worked off."""
    log = None
    for submission in submissions:
        done = process(frames.parse_frames(submission.frames, wire), models)
        rows = submission.state.unionByName(done)
        log = rows if log is None else log.unionByName(rows)
    return log


def check_status(request_ids: DataFrame, state_log: DataFrame) -> DataFrame:
    return state.look_up(request_ids, state_log)
