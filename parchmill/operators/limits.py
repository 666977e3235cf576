"""Rate limiter: fixed windows anchored at a user's first hit.

The first hit opens a window of 60 seconds; every hit in it counts, refused ones
too; the next hit at or after its end opens a new one. This is no tumbling window:
each anchor depends on the one before, so it is worked out by one ordered pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill import schemas as S
from parchmill.operators.hot_windows import open_windows
from parchmill.operators.joins import join_on
from parchmill.operators.slices import SLICE, Slices

# One row of four numbers per slice: 32 MB at most.
BROADCAST_SLICES = 1_000_000
WINDOW_US = S.RATE_WINDOW_S * 1_000_000


def rate_limit(
    hits: DataFrame,
    window_us: int = WINDOW_US,
    limit: int = S.RATE_LIMIT,
    user: str = "user_id",
    pos: str = "ts_us",
    tie: str = "event_id",
    slices: Slices | None = None,
) -> DataFrame:
    """Add window_start_us, n_in_window and limited.

    Users are hash-partitioned and sorted, then streamed through in Arrow batches
    with only the open window carried along, so a task's memory does not depend on
    how many hits a user has. The hits of hot users are cut into slices that start
    from the window ``open_windows`` found to be open there.
    """
    if slices is not None and slices.any_hot:
        windows = open_windows(hits, slices, window_us)
        if slices.total_slices <= BROADCAST_SLICES:
            windows = F.broadcast(windows)
        sliced = join_on(slices.hot(hits), windows, [user, SLICE], "left")
        ordered = in_one_task(sliced, user, SLICE).sortWithinPartitions(user, SLICE, pos, tie)
        hot = count_ordered(ordered, [user, SLICE], pos, window_us, open_window=True).drop(SLICE)
        counted = _count(slices.ordinary(hits), window_us, user, pos, tie).unionByName(hot)
    else:
        counted = _count(hits, window_us, user, pos, tie)
    return counted.withColumn("limited", F.col("n_in_window") > limit)


def in_one_task(df: DataFrame, *keys: str) -> DataFrame:
    """Bring the rows of equal keys into one partition, for a Python stage that relies on it.

    The planner does not know that the stage does. Partitioning by the bare keys would
    be dropped if the input came from a join on them, and adaptive execution may split
    such a join's partitions; a hash of the keys is nothing it can take for granted.
    """
    return df.repartition(F.xxhash64(*keys))


def _count(hits: DataFrame, window_us: int, user: str, pos: str, tie: str) -> DataFrame:
    ordered = in_one_task(hits, user).sortWithinPartitions(user, pos, tie)
    return count_ordered(ordered, [user], pos, window_us)


def count_ordered(hits: DataFrame, keys: list[str], pos: str, window_us: int, open_window: bool = False) -> DataFrame:
    """Count hits that are partitioned by ``keys`` and sorted by keys and time.

    With ``open_window`` the columns open_start and open_count say which window is
    open before the first row of a key; they are consumed.
    """
    consumed = ("open_start", "open_count") if open_window else ()
    kept = [f for f in hits.schema.fields if f.name not in consumed]
    schema = T.StructType(
        [*kept, T.StructField("window_start_us", T.LongType()), T.StructField("n_in_window", T.LongType())]
    )
    names = [f.name for f in kept]
    return hits.mapInArrow(_counter(keys, pos, window_us, open_window, names), schema)


def _exact(column: pa.Array) -> list[np.ndarray]:
    """A key column as arrays that are equal where the keys are: null is a key of its own.

    A nullable integer column with nulls would become floats, in which large keys meet.
    """
    if not column.null_count:
        return [column.to_numpy(zero_copy_only=False)]
    filled = column.fill_null(pa.scalar("" if pa.types.is_string(column.type) else 0, column.type))
    return [filled.to_numpy(zero_copy_only=False), np.asarray(column.is_valid())]


def _counter(
    keys: list[str], pos: str, window_us: int, open_window: bool, kept: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The key at the end of the batch before, as Arrow values, and its open window.
        last_key, start, count = (), None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            columns = [part for k in keys for part in _exact(batch.column(k))]
            changes = np.zeros(n - 1, dtype=bool)
            for column in columns:
                changes |= column[1:] != column[:-1]
            key_starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
            at = batch.column(pos).to_numpy(zero_copy_only=False)
            times = at.tolist()

            # Runs of rows in one window: first row, start of the window, hits before the run.
            first: list[int] = []
            begins: list[int] = []
            before: list[int] = []
            for k, lo in enumerate(key_starts):
                hi = key_starts[k + 1] if k + 1 < len(key_starts) else n
                key = tuple(batch.column(k)[lo].as_py() for k in keys)
                if key != last_key:
                    start, count = None, 0
                    if open_window:
                        start = batch.column("open_start")[lo].as_py()
                        count = batch.column("open_count")[lo].as_py()
                    last_key = key
                i = lo
                while i < hi:
                    if start is None or times[i] >= start + window_us:
                        start, count = times[i], 0
                    j = bisect_left(times, start + window_us, i, hi)
                    first.append(i)
                    begins.append(start)
                    before.append(count)
                    count += j - i
                    i = j

            lengths = np.diff(np.append(np.asarray(first, dtype=np.int64), n))
            starts = np.repeat(np.asarray(begins, dtype=np.int64), lengths)
            counts = np.arange(n) + 1 + np.repeat(np.asarray(before, dtype=np.int64) - np.asarray(first), lengths)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=[*kept, "window_start_us", "n_in_window"],
            )

    return run
