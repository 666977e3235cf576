"""The operators as stages of a pipeline over documents (see corpus_pipeline.py).

Every stage takes all rows of its predecessor and, but for the last, gives back the columns of
``docs``, whatever they are. Names that start with ``_pm_`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import bpe, mil_quality, suffix_dedup, weighted_minhash
from parchmill.llm import positional_index as index
from parchmill.llm.joins import broadcast_if_small
from parchmill.llm.queries import table, vocabulary
from parchmill.llm.sampling import scored
from parchmill.session import cut_lineage


# Rows of whole texts that a Python worker is handed at once: some megabytes, and a bounded number of very long ones.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    bounded_batches(spark)
    model = mil_quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    shared = spark.sparkContext.broadcast(model)
    rows = scored(docs, lambda data: shared.value.score(data), name="_pm_score")
    return rows.where(F.col("_pm_score") >= mil_quality.THRESHOLD).drop("_pm_score")


_KEY = ["_pm_a", "_pm_b"]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id; documents without words stay.

    Rows are told apart by 128 bits of doc_id and text, which come out the same however ``docs`` is
    planned, so it may be any table. Of rows equal in both any one stays.
    """
    bounded_batches(spark)
    hashes = [F.xxhash64(F.lit(seed), "doc_id", F.lit("/"), "text") for seed in (1, 2)]
    keyed = docs.withColumns(dict(zip(_KEY, hashes, strict=True)))
    placed = weighted_minhash.classes(keyed.select("doc_id", "text", *_KEY), _KEY)
    rows = placed.groupBy(*_KEY).agg(F.count("*").alias("_pm_n"), F.count_if("first").alias("_pm_first"))
    marked = cut_lineage(rows.where(F.col("_pm_first") < F.col("_pm_n")))
    marked = broadcast_if_small(marked.select(*_KEY, (F.col("_pm_first") > 0).alias("_pm_again")), 3)
    # Null: all rows of the key stay. True: one of several equal rows stays. False: none does.
    found = keyed.join(marked, _KEY, "left")
    single = found.where(F.col("_pm_again").isNull()).select(*docs.columns)
    return single.unionByName(found.where("_pm_again").dropDuplicates(_KEY).select(*docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the passages that an earlier one has. n_chars follows the text."""
    bounded_batches(spark)
    own = docs.select("doc_id", "text").withColumn("doc", suffix_dedup.document_key(F.col("doc_id"), F.col("text")))
    found = suffix_dedup.repeats(own).select(F.col("doc").alias("_pm_doc"), F.col("spans").alias("_pm_spans"))
    # Rows equal in doc_id and text have equal spans.
    found = cut_lineage(cut_lineage(found).dropDuplicates(["_pm_doc"]))
    n_values = found.agg(F.sum(5 * F.size("_pm_spans") + 1)).first()[0] or 0
    found = broadcast_if_small(found, values=n_values)
    key = suffix_dedup.document_key(docs["doc_id"], docs["text"])
    joined = docs.join(found, key == found["_pm_doc"], "left")
    spans = found["_pm_spans"]
    text = F.when(spans.isNotNull(), suffix_dedup.without_spans(docs["text"], spans)).otherwise(docs["text"])
    others = [docs[name] for name in docs.columns if name != "text"]
    rows = joined.select(*others, text.alias("text"), spans.isNotNull().alias("_pm_cut"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("_pm_cut"), length).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in windows of the benchmark."""
    bounded_batches(spark)
    segments = cut_lineage(index.build(docs.select(F.xxhash64("text").alias("doc_id"), "text")))
    found = index.contamination(index.search(segments, table(spark, sf_dir, "benchmark", "item_id", "text")))
    bad = found.where("contaminated").select(F.col("id").alias("_pm_text")).distinct()
    bad = broadcast_if_small(cut_lineage(bad))
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["_pm_text"], "left_anti")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document; the text itself is not kept."""
    bounded_batches(spark)
    rows = docs.select("doc_id", "lang", "source", "text")
    # Executors are fullest at the end of the pipeline, so less text is worked on together.
    return bpe.round_trip(rows, *vocabulary(), at_once=1_000_000).drop("text")
