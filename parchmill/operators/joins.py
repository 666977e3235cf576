"""Equi joins whose left side may have a key that holds a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sketch finds every key with more than about 1 / TRACKED of all rows.
TRACKED = 20_000
# At most this many keys are ever listed.
LISTED = 10_000
# Rows of a key that one task may hold; above it the key is salted.
SALT_ABOVE = 1_000_000
SALTS = 256


def local_table(spark: SparkSession, columns: dict[str, list], schema: T.StructType) -> DataFrame:
    """A small table from the driver; columns that are not in ``schema`` are bigint."""
    fields = [schema[name] if name in schema.names else T.StructField(name, T.LongType()) for name in columns]
    return spark.createDataFrame(list(zip(*columns.values())), T.StructType(fields))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys are equal too."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_right_{k}" for k in keys))


def frequent_keys(df: DataFrame, key: str, above: int = SALT_ABOVE) -> list:
    """The keys with more than ``above`` rows, LISTED at most; None stands for NULL.

    One pass over one column at plan time: a frequent-items sketch per task, merged to
    a single row, so there is no shuffle by key. It only decides how rows are spread,
    never which rows are in a result.
    """
    value = F.col(key)
    row = (
        df.select(key)
        .agg(
            F.count_if(value.isNull()).alias("n_null"),
            F.expr(f"approx_top_k({key}, {LISTED}, {TRACKED}) FILTER (WHERE {key} IS NOT NULL)").alias("top"),
        )
        .select("n_null", F.filter("top", lambda t: t["count"] > above).alias("top"))
        .first()
    )
    return [t["item"] for t in row["top"] or []] + ([None] if row["n_null"] > above else [])


def join_salted(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None
) -> DataFrame:
    """Join on ``key``, where ``right`` has one row per key and ``left`` any number.

    Without a frequent key this is the plain join, so that a side that is small enough
    is still broadcast. Otherwise the rows of a frequent key are dealt to SALTS tasks,
    and only for such a key the right row is repeated. NULL keys match nothing and are
    dealt out too. The salt comes from the row's content: a task that runs again makes
    the same. A stream's rows are not known at plan time: it takes the plain join.
    """
    if hot is None:
        hot = [] if left.isStreaming else frequent_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    listed = local_table(left.sparkSession, {key: [k for k in hot if k is not None]}, left.schema)
    # At most LISTED rows.
    marked = F.broadcast(listed.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    dealt = left.join(marked, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.lit(0))
    )
    every_salt = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = F.when(F.col("_hot"), every_salt).otherwise(F.array(F.lit(0)))
    repeated = right.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.drop("_hot").join(repeated, [key, "_salt"], how).drop("_salt")
