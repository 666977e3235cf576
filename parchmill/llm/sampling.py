"""Bounded labelled samples and scoring for the classifiers of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm import words as W

HASH_SPACE = 1 << 32


def remainder(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text. Null ids are in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, max_chars: int
) -> tuple[list, float | None]:
    """Training rows (text, label), and the share of label 1 among all training labels (None without any).

    Documents are drawn by a hash of their id from the label table alone: at most ``most`` of each
    label of 0 or 1, so the list of ids has a fixed bound and is broadcast; texts are not shuffled.
    If the drawn texts have more than ``max_chars`` characters, a smaller part is taken. A document
    with both labels, or with a null id, is no training row.
    """
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("doc_id", "label", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HASH_SPACE)).alias("draw"))
    )
    sizes = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if not sizes:
        return [], None
    prior = sizes.get(1, 0) / sum(sizes.values())
    keep = F.lit(False)
    for value, n in sizes.items():
        share = min(1.0, 0.95 * most / n) if n > most else 1.0
        keep |= (F.col("label") == value) & (F.col("draw") < int(share * HASH_SPACE))
    drawn = marks.where(keep).limit(most * len(sizes))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        # The draws are spread evenly over the part of the hash space that was kept.
        part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(HASH_SPACE))
        rows = rows.where(part < int(0.9 * max_chars / chars * HASH_SPACE))
    return rows.select("text", "label").orderBy("doc_id").collect(), prior


def scored(docs: DataFrame, score: Callable[[np.ndarray], float], text: str = "text", name: str = "score") -> DataFrame:
    """Append ``score(bytes)`` of each text. ``docs`` must not have the column yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = pa.array([score(data) for data in W.text_buffers(column)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
