"""Topics as sources and sinks: Kafka, or folders of parquet rows of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill import schemas as S

TOPICS = (S.TOPIC_SUMMARIZE, S.TOPIC_QUESTION)


def kafka_source_options(
    servers: str, topics: tuple[str, ...] = TOPICS, max_offsets_per_trigger: int | None = None
) -> dict[str, str]:
    """Both topics in one subscription, from the earliest offset. Progress is kept in the
    query's checkpoint, which takes the place of a consumer group's commits."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_topics(spark: SparkSession, servers: str, **options) -> DataFrame:
    """Stream of topic rows from Kafka (needs the Kafka connector on the class path)."""
    rows = spark.readStream.format("kafka").options(**kafka_source_options(servers, **options)).load()
    return rows.select(
        "topic", F.col("key").cast("string").alias("key"), "value", "partition", "offset", "timestamp"
    )


def read_topic_folder(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of topic rows from parquet files written by ``append_to_topic_folder``."""
    reader = spark.readStream.schema(S.TOPIC_ROW)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select(*S.TOPIC_ROW.names)


def write_topics(rows: DataFrame, servers: str) -> None:
    """Batch of topic rows to Kafka; each row names its topic."""
    rows.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def stream_topics(rows: DataFrame, servers: str, checkpoint: str):
    """Stream of topic rows to Kafka."""
    return (
        rows.select("topic", "key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def append_to_topic_folder(rows: DataFrame, path: str) -> None:
    """Batch of topic rows to a folder, one subfolder per topic."""
    rows.select("topic", "key", "value", "timestamp").write.mode("append").partitionBy("topic").parquet(path)
