"""Keyed logs on shared storage: the state log, read as newest per request, and the file-cache log,
read as earliest per content.

A log is a folder with

* ``live/writer=W/batch=N/bucket=B``: the rows of each micro-batch; a replayed batch replaces itself;
* ``compact/generation=G/bucket=B``: one row per key, sorted by key, made from everything up to some batch;
* ``manifest/generation=G``: up to which batch of each writer generation G has everything.

``bucket`` is a hash of the key, so a lookup opens the buckets of the keys it is asked for. A manifest is
written after its generation is complete, and files are only removed when a newer generation has
replaced them: a reader sees the old files or the new ones, never both or neither.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill import schemas as S
from parchmill.operators.state import build_cache, latest_state, newest_rows, earliest_rows

# Up to so many asked keys are written into the plan, where they also skip row groups.
FEW_KEYS = 1000

_PLACE = [
    T.StructField("writer", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
]


def write_batch(rows: DataFrame, path: str, batch_id: int, writer: str) -> None:
    """Write the rows of one micro-batch. A replayed batch replaces itself, so delivery
    stays exactly-once in the table."""
    rows.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def _subfolders(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """Values and paths of the folders ``name=value`` below a path."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return {}
    found = (s.getPath() for s in files.listStatus(place) if s.isDirectory())
    return {p.getName().removeprefix(f"{name}="): p.toString() for p in found if p.getName().startswith(f"{name}=")}


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


@dataclass(frozen=True)
class KeyedLog:
    """``reduce`` keeps the row of each key that counts, in the log's own columns. ``buckets`` belongs to the
    log: give the same number for as long as it lives."""

    path: str
    schema: T.StructType
    key: str
    reduce: Callable[[DataFrame], DataFrame]
    buckets: int = S.LOG_BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch_id: int, writer: str) -> None:
        """Write one micro-batch; a replay of it replaces it."""
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        folder = f"{self.path}/live/writer={writer}/batch={batch_id}"
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """All rows that may count, or only those of ``keys`` (a table with the key column).

        Not reduced: several rows of a key can be there, from batches that are not compacted yet.
        """
        generation, covers = self._newest_generation(spark)
        parts = []
        if _exists(spark, f"{self.path}/live"):
            live = spark.read.schema(T.StructType([*self.schema, *_PLACE])).parquet(f"{self.path}/live")
            for writer, upto in covers.items():
                live = live.filter((F.col("writer") != writer) | (F.col("batch") > upto))
            parts.append(live)
        if generation is not None:
            folder = f"{self.path}/compact/generation={generation}"
            parts.append(spark.read.schema(T.StructType([*self.schema, _PLACE[2]])).parquet(folder))
        if not parts:
            return spark.createDataFrame([], self.schema)
        if keys is not None:
            cut = self._cut(keys)
            parts = [cut(part) for part in parts]
        rows = [part.select(*self.schema.names) for part in parts]
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def compact(self, spark: SparkSession) -> int | None:
        """Make a new generation of all batches but each writer's last, which may still be replayed.

        Returns its number, or None if there is nothing to add. One compaction at a time.
        """
        generation, covers = self._newest_generation(spark)
        upto = dict(covers)
        for writer, folder in _subfolders(spark, f"{self.path}/live", "writer").items():
            last = max((int(n) for n in _subfolders(spark, folder, "batch")), default=-1)
            if last - 1 > covers.get(writer, -1):
                upto[writer] = last - 1
        if upto == covers:
            return None
        live = spark.read.schema(T.StructType([*self.schema, *_PLACE])).parquet(f"{self.path}/live")
        taken = F.lit(False)
        for writer, batch in upto.items():
            taken |= (F.col("writer") == writer) & F.col("batch").between(covers.get(writer, -1) + 1, batch)
        rows = live.filter(taken).select(*self.schema.names)
        if generation is not None:
            folder = f"{self.path}/compact/generation={generation}"
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(folder).select(*self.schema.names))
        new = 0 if generation is None else generation + 1
        kept = self.reduce(rows).select(*self.schema.names).withColumn("bucket", self.bucket())
        ordered = kept.repartition("bucket").sortWithinPartitions("bucket", self.key)
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/compact/generation={new}")
        listed = spark.createDataFrame(list(upto.items()), "writer string, upto bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={new}")
        return new

    def vacuum(self, spark: SparkSession, keep: int = 1) -> None:
        """Remove what only generations older than the last ``keep`` + 1 need.

        Readers that began before the newest generation was there, and read an older one that is kept, go on undisturbed.
        """
        generation, _ = self._newest_generation(spark)
        oldest = -1 if generation is None else generation - keep
        if oldest < 0:
            return
        covers = self._covers(spark, oldest)
        for writer, folder in _subfolders(spark, f"{self.path}/live", "writer").items():
            for batch, place in _subfolders(spark, folder, "batch").items():
                if int(batch) <= covers.get(writer, -1):
                    _delete(spark, place)
        for kind in ("manifest", "compact"):
            for number, place in _subfolders(spark, f"{self.path}/{kind}", "generation").items():
                if int(number) < oldest:
                    _delete(spark, place)

    def _newest_generation(self, spark: SparkSession) -> tuple[int | None, dict[str, int]]:
        """A generation counts from when its manifest is written to the end."""
        done = [
            int(number)
            for number, folder in _subfolders(spark, f"{self.path}/manifest", "generation").items()
            if _exists(spark, f"{folder}/_SUCCESS")
        ]
        return (max(done), self._covers(spark, max(done))) if done else (None, {})

    def _covers(self, spark: SparkSession, generation: int) -> dict[str, int]:
        """One row per writer."""
        return {r["writer"]: r["upto"] for r in spark.read.parquet(f"{self.path}/manifest/generation={generation}").collect()}

    def _cut(self, keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
        asked = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        few = [row[0] for row in asked.limit(FEW_KEYS + 1).collect()]
        buckets = [row[0] for row in asked.select(self.bucket()).distinct().collect()]

        def cut(rows: DataFrame) -> DataFrame:
            rows = rows.filter(F.col("bucket").isin(buckets))
            if len(few) <= FEW_KEYS:
                return rows.filter(F.col(self.key).isin(few))
            return rows.join(asked, self.key, "left_semi")

        return cut


def state_log(path: str) -> KeyedLog:
    return KeyedLog(path, S.STATE_ROW, "request_id", newest_rows)


def cache_log(path: str) -> KeyedLog:
    return KeyedLog(path, S.CACHE_LOG, "content_sha", earliest_rows)


def read_state_log(spark: SparkSession, path: str) -> DataFrame:
    return state_log(path).read(spark)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest_state(read_state_log(spark, path))


def read_latest_of(spark: SparkSession, path: str, request_ids: DataFrame) -> DataFrame:
    """As ``read_latest``, of the asked ids: only their buckets and rows are read and reduced."""
    return latest_state(state_log(path).read(spark, request_ids))


def append_cache(results: DataFrame, path: str, batch_id: int, writer: str = "bot") -> None:
    """Log file results (content_sha, summary, done_us, event_id, ok) for the cache."""
    cache_log(path).write(results, batch_id, writer)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache as of now: the earliest good result of every content."""
    return build_cache(cache_log(path).read(spark))
