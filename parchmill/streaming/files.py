"""Uploaded files and questions about them as streams.

``run_file_gateway``: files -> intake table -> state ``processing`` + summary frames + refusals.
``pair_stream`` and ``run_question_gateway``: questions meet the intake table's texts by upload, whichever
comes first -> state + question frames + refusals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators import extract, frames
from parchmill.plans import service
from parchmill.sources import results
from parchmill.streaming.worker import TopicSink


def run_file_gateway(
    files: DataFrame,
    intake_path: str,
    state_path: str,
    sink: TopicSink,
    rejects_path: str,
    checkpoint: str,
    pdf_reader: extract.PartReader | None = None,
    ocr_reader: extract.PartReader | None = None,
    docx_reader: extract.PartReader = extract.read_docx_paragraphs,
    wire: str = "json",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the intake on a stream of files (path, filename, content, modified).

    Every micro-batch is extracted once and written to the intake table with its ids; all else is made from
    there. The ids come from the files themselves, so a replayed batch has the same ones and replaces itself everywhere.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        results.write_batch(service.take_in(batch, pdf_reader, ocr_reader, docx_reader), intake_path, batch_id, "files")
        folder = f"{intake_path}/writer=files/batch={batch_id}"
        taken = batch.sparkSession.read.schema(S.INTAKE_ROW).parquet(folder)
        submission = service.submit_taken(taken, wire)
        results.write_batch(submission.rejected, rejects_path, batch_id, "files")
        results.state_log(state_path).write(submission.state, batch_id, "files")
        sink(submission.frames, batch_id)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_intake(spark: SparkSession, intake_path: str) -> DataFrame:
    return spark.read.schema(S.INTAKE_ROW).parquet(intake_path).select(*S.INTAKE_ROW.names)


def stream_intake(spark: SparkSession, intake_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the intake table of a ``run_file_gateway``."""
    reader = spark.readStream.schema(S.INTAKE_ROW)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(intake_path).select(*S.INTAKE_ROW.names)


def pair_stream(
    taken: DataFrame, questions: DataFrame, on: str = "path", wait: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Streams of intake rows and of questions (request_id, ``on``, question, ts) -> one row per question
    with text and ``error``.

    A question waits for its file, and a file for its questions, at most ``wait`` by their times. A question
    whose file does not come is given ``NO_FILE`` when the watermark has passed that. Of several files under one
    key the first within ``delay`` is taken. The context is cut before it is kept.
    """
    texts = taken.withWatermark("ts", delay).dropDuplicatesWithinWatermark([on])
    texts = texts.select(
        F.col(on).alias("_on"),
        F.when(F.col("error").isNull(), tx.truncate_context(F.col("text"))).alias("text"),
        F.col("error").alias("file_error"),
        F.col("ts").alias("file_ts"),
    )
    asked = questions.withWatermark("ts", delay)
    near = (F.col("file_ts") >= F.col("ts") - F.expr(f"INTERVAL {wait}")) & (
        F.col("file_ts") <= F.col("ts") + F.expr(f"INTERVAL {wait}")
    )
    met = asked.join(texts, (F.col(on) == F.col("_on")) & near, "leftOuter")
    error = F.when(F.col("file_ts").isNull(), F.lit(S.NO_FILE)).otherwise(F.col("file_error"))
    return met.withColumn("error", error).select("request_id", on, "text", "question", "ts", "error")


def run_question_gateway(
    pairs: DataFrame,
    state_path: str,
    sink: TopicSink,
    rejects_path: str,
    checkpoint: str,
    wire: str = "json",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the intake of questions on a ``pair_stream``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            refused = extract.rejected_requests(batch).drop("text", "question")
            results.write_batch(refused, rejects_path, batch_id, "questions")
            taken = extract.accepted_requests(batch)
            results.state_log(state_path).write(frames.processing_rows(taken), batch_id, "questions")
            sink(frames.question_frames(taken, wire), batch_id)
        finally:
            batch.unpersist()

    return (
        pairs.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
