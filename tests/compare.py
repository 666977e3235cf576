"""Run catalogue queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        path = os.path.join(sf_dir, f"{name}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return sorted(columns), sorted(rows, key=repr)


TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


def type_differences(con: duckdb.DuckDBPyConnection, df: DataFrame, sql: str) -> list[str]:
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for name, kind in df.dtypes:
        if TYPES.get(kind) != described.get(name) and described.get(name) != '"NULL"':
            out.append(f"{name}: {kind} / {described.get(name)}")
    return out


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> list[str]:
    """Differences as text; empty when both engines agree."""
    df = query(spark, sf_dir)
    problems = type_differences(con, df, sql)
    names, ours = spark_rows(df)
    other_names, theirs = duck_rows(con, sql)
    if names != other_names:
        return [*problems, f"columns {names} / {other_names}"]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    if not ours:
        problems.append("no rows")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0][0]} / {bad[0][1]}")
    return problems
