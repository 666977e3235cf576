"""The training-data pipeline: stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmill.llm.stages import (
    decontaminate,
    drop_near_duplicates,
    drop_rejected,
    drop_repeated_passages,
    encode_and_decode,
)
from parchmill.session import configure, cut_lineage

STAGES = [
    ("quality", drop_rejected),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", decontaminate),
    ("tokens", encode_and_decode),
]

# The stages fit a model, draw hashes and merge byte pairs; SQL expresses none of these.
# tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
