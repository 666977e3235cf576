"""The request service as two streaming queries joined by the topics.

``run_gateway``: submissions -> state ``processing`` + topic frames.
``run_worker``: topic frames -> summaries and answers -> state, bad frames -> dead letters.

The text operators are map-only, so a micro-batch has no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmill import schemas as S
from parchmill.operators import frames
from parchmill.plans.service import Models, process
from parchmill.sources import results, topics


def run_worker(
    rows: DataFrame,
    state_path: str,
    dead_letter_path: str,
    checkpoint: str,
    wire: str = "json",
    models: Models = Models(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the worker on a stream of topic rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = frames.parse_frames(batch, wire).persist()
        try:
            results.state_log(state_path).write(process(parsed, models), batch_id, "worker")
            results.write_batch(frames.dead_letters(parsed), dead_letter_path, batch_id, "worker")
        finally:
            parsed.unpersist()

    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# Takes the topic rows of a micro-batch and its number.
TopicSink = Callable[[DataFrame, int], None]


def folder_sink(path: str) -> TopicSink:
    """Topic rows as parquet files; a replayed batch replaces itself."""

    def send(rows: DataFrame, batch_id: int) -> None:
        placed = rows.withColumns({"partition": F.lit(0), "offset": F.lit(None).cast("bigint")})
        placed.select(*S.TOPIC_ROW.names).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return send


def kafka_sink(servers: str) -> TopicSink:
    """Topic rows to Kafka; a replayed batch is sent again, which the worker's state
    absorbs."""
    return lambda rows, batch_id: topics.write_topics(rows, servers)


def run_gateway(
    requests: DataFrame,
    state_path: str,
    sink: TopicSink,
    checkpoint: str,
    wire: str = "json",
    trigger: dict | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Start the intake on a stream of submissions (request_id, text, question, ts).

    A NULL question makes a summary request, and any text will do for it. What has no text, and
    a question to an empty one, gets no frame and no state, and goes to the folder ``rejects``
    (request_id, error, ts; a folder per batch). The state is written before the frames, as a reader of the frames may
    answer at once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        text, question = F.col("text"), F.col("question")
        fits = text.isNotNull() & (question.isNull() | (text != ""))
        accepted = batch.filter(fits)
        try:
            if rejects is not None:
                refused = batch.filter(~fits)
                error = F.when(F.col("text").isNull(), S.NO_TEXT).otherwise(S.EXTRACT_FAILED)
                refused.select("request_id", error.alias("error"), "ts").write.mode("overwrite").parquet(
                    f"{rejects}/batch={batch_id}"
                )
            results.state_log(state_path).write(frames.processing_rows(accepted), batch_id, "gateway")
            summaries = frames.summarize_frames(accepted.filter(F.col("question").isNull()), wire)
            questions = frames.question_frames(accepted.filter(F.col("question").isNotNull()), wire)
            sink(summaries.unionByName(questions), batch_id)
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def distinct_deliveries(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop rows delivered twice within the watermark delay. Later repeats overwrite the
    same request in the state log, which does no harm."""
    return rows.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["topic", "key"])

