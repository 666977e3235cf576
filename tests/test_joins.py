from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.operators.joins import SALTS, frequent_keys, join_salted


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string"))
    return spark.range(3000).select("id", key.alias("k"))


def test_frequent_keys(spark):
    left = skewed(spark)
    assert frequent_keys(left, "k", above=500) == ["hot"]
    assert frequent_keys(left, "k", above=200) == ["hot", None]
    assert frequent_keys(left, "k") == []
    assert frequent_keys(left.limit(0), "k") == []


def test_salted_joins_give_the_same_rows(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("49", 3), ("unused", 4)], "k string, v int")
    hot = frequent_keys(left, "k", above=500)
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "k", "v")
        assert rows(join_salted(left, right, "k", how, hot).select("id", "k", "v")) == rows(plain)
        assert rows(join_salted(left, right, "k", how).select("id", "k", "v")) == rows(plain)


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    left, right = skewed(spark), spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = join_salted(left, right, "k", "left", frequent_keys(left, "k", above=500))
        parts = joined.filter("k = 'hot' or k is null").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        for key, value in (("autoBroadcastJoinThreshold", None), ("adaptive.enabled", "true"), ("shuffle.partitions", "4")):
            spark.conf.unset(f"spark.sql.{key}") if value is None else spark.conf.set(f"spark.sql.{key}", value)
    assert len(parts) > 40 and max(p["count"] for p in parts) < 150
    assert SALTS >= 64
