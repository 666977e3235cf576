from __future__ import annotations

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from parchmill.plans import catalogue, oracle
from parchmill.functions import text as tx
from parchmill.operators import frames
from parchmill.operators.answer import answer
from parchmill.operators.summarize import summarize
from parchmill.operators.translate import IDENTITY, translate
from parchmill.session import spread
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_in_both_engines(spark, con, sf_dir, name):
    assert compare(spark, con, catalogue.queries()[name], oracle.oracle_sql()[name], sf_dir) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


TEXT_OPERATORS = {
    "summarize": lambda docs: summarize(docs),
    "answer": lambda docs: answer(docs.withColumn("question", F.lit("why"))),
    "translate": lambda docs: translate(docs, IDENTITY),
    "chunks": lambda docs: docs.select("doc_id", F.posexplode(tx.chunks(F.col("text")))),
    "frames": lambda docs: frames.summarize_frames(docs.selectExpr("'a' as request_id", "text", "doc_id as ts")),
}


@pytest.mark.parametrize("name", sorted(TEXT_OPERATORS))
def test_text_operators_do_not_shuffle_and_read_their_columns_only(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = TEXT_OPERATORS[name](docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_spread_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert "Exchange" not in plan_of(spread(spark.range(100, numPartitions=2 * cores)))
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
