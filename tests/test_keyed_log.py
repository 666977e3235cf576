from __future__ import annotations

import glob
import random
import re

from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators.state import latest_state, look_up, lookup_status
from parchmill.sources import results
from parchmill.sources.results import KeyedLog, newest_rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, "request_id string, value string, state_rank int, ok boolean, t bigint")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def some_rows(rng, number):
    return [(f"r{rng.randrange(60)}", f"v{number}-{i}", 1, True, rng.randrange(500)) for i in range(5)]


def latest(log, spark):
    return sorted(tuple(r) for r in latest_state(log.read(spark)).select("request_id", "value").collect())


def files(path):
    return [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]


def test_compaction_bounds_the_files_and_changes_no_result(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "log")
    log = KeyedLog(path, S.STATE_ROW, "request_id", newest_rows, buckets=4)
    written, most = [], 0
    for number in range(100):
        rows = some_rows(rng, number)
        written += rows
        log.write(batch(spark, rows), number // 2, ("gateway", "worker")[number % 2])
        if number % 20 == 19:
            open_reader = log.read(spark)
            before = latest(log, spark)
            generation = log.compact(spark)
            assert generation == number // 20
            assert latest(log, spark) == before
            # A reader planned before the compaction and the vacuum still finds its files.
            log.vacuum(spark)
            assert sorted(tuple(r) for r in latest_state(open_reader).select("request_id", "value").collect()) == before
            most = max(most, len(files(path)))
    expected = latest_state(batch(spark, written)).select("request_id", "value").collect()
    assert latest(log, spark) == sorted(tuple(r) for r in expected)
    # Two generations of 4 buckets with their manifests, and the batches of the last two rounds.
    assert most <= 2 * (4 + 1) + 2 * 22 * 4
    assert log.compact(spark) is None


def test_an_unfinished_generation_does_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    log = KeyedLog(path, S.STATE_ROW, "request_id", newest_rows, buckets=4)
    for number in range(3):
        log.write(batch(spark, [(f"k{number}", "v", 1, True, 1)]), number, "w")
    assert log.compact(spark) == 0
    # The next one was cut off before its manifest, and the last batch is replayed with another content.
    batch(spark, [("wrong", "x", 1, True, 9)]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{path}/compact/generation=1")
    log.write(batch(spark, [("k9", "v", 1, True, 1)]), 2, "w")
    assert [k for k, _ in latest(log, spark)] == ["k0", "k1", "k9"]
    log.write(batch(spark, [("k3", "v", 1, True, 1)]), 3, "w")
    assert log.compact(spark) == 1
    assert [k for k, _ in latest(log, spark)] == ["k0", "k1", "k3", "k9"]


def test_a_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"r{i}", f"v{i}", 1, True, i) for i in range(400)] + [(f"r{i}", "processing", 0, True, 0) for i in range(400)]
    log = results.state_log(path)
    for number in range(3):
        log.write(batch(spark, rows[number::3]), number, "w")
    log.compact(spark)
    asked = spark.createDataFrame([("r7",), ("r200",), ("absent",), ("r7",), (None,)], "request_id string")
    newest = results.read_latest_of(spark, path, asked)
    told = lookup_status(asked, newest).select("request_id", "status", "summary").collect()
    assert sorted(map(tuple, told), key=repr) == sorted(
        [("r7", "done", "v7"), ("r7", "done", "v7"), ("r200", "done", "v200"), ("absent", "not_found", None), (None, "not_found", None)], key=repr
    )
    plan = newest._jdf.queryExecution().executedPlan().toString()
    partitions = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert partitions and all("bucket" in p for p in partitions)
    assert "In(request_id" in plan and "PushedFilters" in plan
    read = log.read(spark, asked)
    assert read.count() < 20
    everything = log.read(spark).select(F.input_file_name().alias("f")).distinct().count()
    assert everything > 100
    scans = [m for m in re.findall(r"In\(bucket#\d+, \[(.*?)\]|bucket#\d+ IN \((.*?)\)", plan) if any(m)]
    assert scans and all(len((a or b).split(",")) <= 3 < S.LOG_BUCKETS for a, b in scans)


def test_many_keys_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "FEW_KEYS", 10)
    log = results.state_log(str(tmp_path / "log"))
    log.write(batch(spark, [(f"r{i}", f"v{i}", 1, True, i) for i in range(200)]), 0, "w")
    asked = spark.createDataFrame([(f"r{i}",) for i in range(50)], "request_id string")
    assert sorted(r.request_id for r in log.read(spark, asked).collect()) == sorted(f"r{i}" for i in range(50))


def test_rows_of_other_ids_are_left_out_before_the_reduction(spark):
    rows = [(f"r{i % 20}", f"v{i}", i % 2, True, i) for i in range(200)]
    asked = spark.createDataFrame([("r3",), ("x",)], "request_id string")
    found = look_up(asked, batch(spark, rows))
    assert sorted(map(tuple, found.select("request_id", "status", "summary").collect())) == [("r3", "done", "v183"), ("x", "not_found", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    key = re.search(r"max_by\(.*?, (?:named_)?struct\((.*?)\)", plan)
    assert key is None or "xxhash64" in plan


def test_the_cache_log_is_compacted_too(spark, tmp_path):
    log = results.cache_log(str(tmp_path / "cache"))
    for number, rows in enumerate([[("x", "a", 20, 1, True)], [("x", "b", 10, 2, True), ("y", "c", 5, 3, False)], [("z", "d", 1, 4, True)]]):
        log.write(spark.createDataFrame(rows, S.CACHE_LOG), number, "bot")
    assert log.compact(spark) == 0
    assert sorted(tuple(r) for r in results.read_cache(spark, log.path).collect()) == [("x", 10, "b"), ("z", 1, "d")]


def test_an_empty_log(spark, tmp_path):
    log = results.state_log(str(tmp_path / "none"))
    assert log.read(spark).count() == 0 and log.compact(spark) is None
    log.vacuum(spark)
