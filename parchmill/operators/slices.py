"""Order-dependent running values that survive a hot key.

A window over ``partitionBy(user)`` puts all rows of a user in one task. That is
fine until one user owns a third of the table. Here the rows of such a key are
cut along the order column into slices of bounded size, the slices are summed up
first (a partial aggregate, so little is shuffled), and every slice starts with
one seed row that brings the running value of the slices before it.

Keys below the bound keep the plain window, and if no key is above it the plan is
the plain window and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.operators.joins import frequent_keys, join_on, local_table

# Rows of one key that one task may hold.
HOT_ROWS = 4_000_000
# Every entry of a slice table owns more than ``hot_rows`` rows, so the tables hold
# at most rows / hot_rows entries; beyond this many the bound is raised instead.
MAX_ENTRIES = 100_000
MAX_LEVELS = 8

SLICE = "_slice"
_SEED = "_seed"


@dataclass(frozen=True)
class Slices:
    """How the hot values of ``key``, NULL among them, are cut along the bigint column ``pos``.

    ``levels[0]`` maps a key to (start, width) of equal-width slices; every further
    level cuts slices that are still too large. A slice is named by its start.
    """

    key: str
    pos: str
    levels: tuple[DataFrame, ...] = ()
    # Upper bounds on the slices of any one key, and of all hot keys together.
    max_slices: int = 1
    total_slices: int = 0

    @property
    def any_hot(self) -> bool:
        return bool(self.levels)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice column; keys that are not hot get NULL there."""
        for depth, level in enumerate(self.levels):
            on = [self.key] if depth == 0 else [self.key, SLICE]
            # Bounded by MAX_ENTRIES rows of three numbers.
            df = join_on(df, F.broadcast(level), on, "left")
            pos = F.col(self.pos)
            start = F.col("_start") if depth == 0 else F.col(SLICE)
            cut = start + F.call_function("div", pos - start, F.col("_width")) * F.col("_width")
            kept = F.lit(None).cast("bigint") if depth == 0 else F.col(SLICE)
            df = df.withColumn(SLICE, F.when(F.col("_width").isNotNull(), cut).otherwise(kept))
            df = df.drop("_start", "_width")
        return df

    def hot(self, df: DataFrame) -> DataFrame:
        """Only the rows of hot keys, with their slice."""
        keys = self.levels[0].select(self.key)
        return self.assign(join_on(df, F.broadcast(keys), [self.key], "left_semi"))

    def ordinary(self, df: DataFrame) -> DataFrame:
        keys = self.levels[0].select(self.key)
        return join_on(df, F.broadcast(keys), [self.key], "left_anti")


def find_slices(df: DataFrame, key: str, pos: str, hot_rows: int = HOT_ROWS) -> Slices:
    """Find the hot keys and cut them.

    Runs at plan time, on two narrow columns. A sketch lists the candidates without a
    shuffle by key; if there are any, they are counted exactly, and only entries above
    ``hot_rows`` reach the driver.
    """
    narrow = df.select(key, pos)
    candidates = frequent_keys(narrow, key, hot_rows)
    if not candidates:
        return Slices(key, pos)
    # At most LISTED keys.
    listed = local_table(df.sparkSession, {key: candidates}, narrow.schema)
    suspects = join_on(narrow, F.broadcast(listed), [key], "left_semi")
    levels: list[DataFrame] = []
    found = _crowded(suspects, [key], pos, hot_rows)
    while len(found) > MAX_ENTRIES:
        hot_rows *= 4
        found = _crowded(suspects, [key], pos, hot_rows)
    n_slices: dict[object, int] = {}
    while found and len(levels) < MAX_LEVELS:
        depth = len(levels)
        entries: dict[str, list] = {key: [], "_start" if depth == 0 else SLICE: [], "_width": []}
        for row in found:
            start = row["lo"] if depth == 0 else row[SLICE]
            parts = 2 * -(-row["n"] // hot_rows)
            for column, value in zip(entries.values(), (row[key], start, max(1, -(-(row["hi"] - start + 1) // parts)))):
                column.append(value)
            n_slices[row[key]] = n_slices.get(row[key], 1) + parts
        levels.append(local_table(df.sparkSession, entries, narrow.schema))
        so_far = Slices(key, pos, tuple(levels))
        found = _crowded(so_far.hot(narrow), [key, SLICE], pos, hot_rows)
    return Slices(key, pos, tuple(levels), max(n_slices.values(), default=1), sum(n_slices.values()))


def _crowded(df: DataFrame, keys: list[str], pos: str, hot_rows: int) -> list:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    # A crowd at a single position cannot be cut along it.
    return counted.filter((F.col("n") > hot_rows) & (F.col("lo") < F.col("hi"))).limit(MAX_ENTRIES + 1).collect()


@dataclass(frozen=True)
class Running:
    """A running value over the *earlier* rows of a key.

    ``last``: latest non-NULL value; ``sum``; ``min``.
    """

    kind: str
    value: Column


def add_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    slices: Slices | None = None,
) -> DataFrame:
    """Add one column per entry of ``values``.

    ``order`` must be total within a key, and start with the column that ``slices``
    cuts along.
    """
    marked = df.withColumns({f"_m_{name}": r.value for name, r in values.items()})
    markers = [f"_m_{name}" for name in values]
    if slices is None or not slices.any_hot:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return _windowed(marked, values, over).drop(*markers)

    over = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(F.col(_SEED).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = _seed_rows(slices.hot(marked), keys, order, values)
    rows = slices.assign(marked).withColumn(_SEED, F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    return _windowed(rows, values, over).filter(F.col(_SEED) == 0).drop(*markers, SLICE, _SEED)


def _windowed(df: DataFrame, values: dict[str, Running], over) -> DataFrame:
    columns = {}
    for name, running in values.items():
        marker = F.col(f"_m_{name}")
        if running.kind == "last":
            columns[name] = F.last(marker, ignorenulls=True).over(over)
        elif running.kind == "sum":
            columns[name] = F.coalesce(F.sum(marker).over(over), F.lit(0).cast("bigint"))
        elif running.kind == "min":
            columns[name] = F.min(marker).over(over)
        else:
            raise ValueError(f"unknown running value: {running.kind}")
    return df.withColumns(columns)


def _seed_rows(hot: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running]) -> DataFrame:
    """One row per (key, slice): the running values of all earlier slices."""
    totals = []
    for name, running in values.items():
        marker = F.col(f"_m_{name}")
        if running.kind == "last":
            at = F.when(marker.isNotNull(), F.struct(*order))
            totals.append(F.max_by(marker, at).alias(f"_m_{name}"))
        elif running.kind == "sum":
            totals.append(F.sum(marker).alias(f"_m_{name}"))
        else:
            totals.append(F.min(marker).alias(f"_m_{name}"))
    per_slice = hot.groupBy(*keys, SLICE).agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for name, running in values.items():
        marker = F.col(f"_m_{name}")
        if running.kind == "last":
            columns.append(F.last(marker, ignorenulls=True).over(earlier).alias(f"_m_{name}"))
        elif running.kind == "sum":
            columns.append(F.sum(marker).over(earlier).alias(f"_m_{name}"))
        else:
            columns.append(F.min(marker).over(earlier).alias(f"_m_{name}"))
    return per_slice.select(*keys, SLICE, *columns, F.lit(1).alias(_SEED))
