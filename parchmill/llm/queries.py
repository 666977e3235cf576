"""The operators of this folder on the given tables, as named queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import bpe, html_text, license_scan, mil_quality, periodic_runs, rp_forest, suffix_dedup, tile_search
from parchmill.llm import toxicity_fm, url_rules, warc, weighted_minhash
from parchmill.llm import positional_index as index
from parchmill.session import configure, cut_lineage, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the vocabulary in use. The file is read by the driver alone."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_lineage(index.build(table(spark, sf_dir, "documents", "doc_id", "text")))
    hits = index.search(segments, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return index.contamination(hits).withColumnRenamed("id", "doc_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    keyed = documents.withColumn("doc", suffix_dedup.document_key(F.col("doc_id"), F.col("text")))
    spans = suffix_dedup.repeats(keyed).select("doc_id", F.explode("spans").alias("span"))
    return spans.select(
        "doc_id",
        F.col("span.start_word").cast("long").alias("start_word"),
        (F.col("span.end_word") - F.col("span.start_word")).cast("long").alias("n_words"),
        F.col("span.first_doc_id").alias("first_doc_id"),
    )


@query
def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    lines = warc.archive_and_index(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return lines.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = mil_quality.train(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return mil_quality.quality(documents, model)


@query
def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity_fm.train(documents, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity_fm.toxicity(documents, model)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(documents, *vocabulary()).drop("text")


@query
def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return rp_forest.neighbours(embeddings, F.col("id") % 50 == 0)


@query
def op11_tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return tile_search.search(documents, table(spark, sf_dir, "benchmark", "item_id", "text"))


# Of a run's columns, those that the query shows.
RUN_COLUMNS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return periodic_runs.periodic_runs(documents, tails=True, columns=RUN_COLUMNS)


# Verdict, host and path of the rules in use.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_rule(*rule) for rule in URL_RULES]
    return url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")
