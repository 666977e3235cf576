"""Log folders as sources, parsed logs as a table partitioned by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _labelled(lines: DataFrame, job: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return lines.select(
        "value",
        path.alias("file_path"),
        F.lit(job).alias("job"),
        F.create_map(F.lit("job"), F.lit(job), F.lit("filename"), path).alias("labels"),
    )


def read_logs(spark: SparkSession, jobs: dict[str, str]) -> DataFrame:
    """Lines of all jobs; ``jobs`` maps a label to a path pattern."""
    return reduce(DataFrame.unionByName, [_labelled(spark.read.text(glob), job) for job, glob in jobs.items()])


def stream_logs(spark: SparkSession, jobs: dict[str, str]) -> DataFrame:
    """As ``read_logs``, following new files."""
    return reduce(
        DataFrame.unionByName, [_labelled(spark.readStream.text(glob), job) for job, glob in jobs.items()]
    )


def write_log_table(rows: DataFrame, path: str) -> None:
    """Append parsed rows, one partition per day.

    Rows are brought together by day first, so a day gets as many files as its size asks for, not one per task.
    """
    dated = rows.withColumn("log_date", F.to_date("ts")).hint("rebalance", "log_date")
    dated.write.mode("append").partitionBy("log_date").parquet(path)
