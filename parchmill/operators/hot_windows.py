"""Which limiter window is open at the start of each slice of a hot user.

Every anchor of the limiter depends on the one before, so slices of one user
cannot simply be counted on their own. But a slice acts on the window left open
before it as a monotone step function: "the first hit at or after the end of the
open window starts the next chain, which ends at such an anchor". These functions
compose, so the slices are worked out in parallel as a prefix scan: functions per
slice, composed upwards in groups, then applied downwards from the first slice.

A function needs one step per distinct hit within the first window of its slice:
later hits are never the first ones after the window before.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.operators.joins import join_on
from parchmill.operators.slices import SLICE, Slices
from parchmill.session import cut_lineage

FAN_IN = 8
_NO_ENTRY = np.iinfo(np.int64).max


class Steps(NamedTuple):
    """A slice, or a run of slices, as a function of the window open before it.

    An open window that ends at x leads to the first ``entry`` >= x: the window open
    afterwards starts at its ``exit`` and holds ``tail`` hits. Without such an entry
    the window stays, and gains ``total`` hits.
    """

    entry: np.ndarray
    exit: np.ndarray
    tail: np.ndarray
    total: int


def steps_of_slice(times: np.ndarray, counts: np.ndarray, start: int, window_us: int) -> Steps:
    """From the sorted distinct hit times of a slice and the hits at each."""
    n = len(times)
    following = np.searchsorted(times, times + window_us)
    last = np.where(following < n, following, np.arange(n))
    # Pointer doubling: from every hit to the last anchor of its chain.
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    hits_from = counts[::-1].cumsum()[::-1]
    reach = min(n, int(np.searchsorted(times, start + window_us)) + 1)
    return Steps(times[:reach], times[last[:reach]], hits_from[last[:reach]], int(counts.sum()))


def advance(steps: Steps, starts: np.ndarray, counts: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Apply a function to open windows."""
    if len(steps.entry) == 0:
        return starts, counts + steps.total
    at = np.searchsorted(steps.entry, starts + window_us)
    found = at < len(steps.entry)
    at = np.minimum(at, len(steps.entry) - 1)
    return np.where(found, steps.exit[at], starts), np.where(found, steps.tail[at], counts + steps.total)


def compose(run: list[Steps], start: int, window_us: int) -> Steps:
    """One function for consecutive slices."""
    entries, exits, tails = [], [], []
    for i, steps in enumerate(run):
        exit_, tail = steps.exit, steps.tail
        for later in run[i + 1 :]:
            exit_, tail = advance(later, exit_, tail, window_us)
        entries.append(steps.entry)
        exits.append(exit_)
        tails.append(tail)
    entry = np.concatenate(entries)
    reach = min(len(entry), int(np.searchsorted(entry, start + window_us)) + 1)
    return Steps(
        entry[:reach],
        np.concatenate(exits)[:reach],
        np.concatenate(tails)[:reach],
        sum(steps.total for steps in run),
    )


def _to_frame(key: object, key_name: str, node: int, start: int, steps: Steps) -> pd.DataFrame:
    # The last row, with an entry nothing reaches, carries the total.
    return pd.DataFrame(
        {
            "entry": np.append(steps.entry, _NO_ENTRY),
            "exit": np.append(steps.exit, 0),
            "tail": np.append(steps.tail, steps.total),
        }
    ).assign(**{key_name: _value(key), "node": node, "start": start})


def _value(key: object) -> object:
    """A group's key; pandas shows a NULL as NaN."""
    return None if pd.isna(key) else key


def _from_frame(pdf: pd.DataFrame) -> list[tuple[int, int, Steps]]:
    """(node, start, function) in order."""
    out = []
    for (start, node), rows in pdf.sort_values(["start", "entry"]).groupby(["start", "node"], sort=True):
        entry, exit_, tail = (rows[c].to_numpy() for c in ("entry", "exit", "tail"))
        out.append((int(node), int(start), Steps(entry[:-1], exit_[:-1], tail[:-1], int(tail[-1]))))
    return out


def open_windows(hits: DataFrame, slices: Slices, window_us: int) -> DataFrame:
    """(key, slice, open_start, open_count) for the slices of hot keys; NULL and 0 where
    no window is open."""
    key, pos = slices.key, slices.pos
    key_field = T.StructField(key, hits.schema[key].dataType)

    def long(*names: str) -> list[T.StructField]:
        return [T.StructField(name, T.LongType()) for name in names]

    table = T.StructType([*long("entry", "exit", "tail"), key_field, *long("node", "start")])
    state = T.StructType([key_field, *long("node", "open_start", "open_count")])

    # Hits of the same instant are combined before the shuffle.
    points = slices.hot(hits.select(key, pos)).groupBy(key, SLICE, pos).agg(F.count(F.lit(1)).alias("n"))

    def slice_steps(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        user, start = group
        pdf = pdf.sort_values(pos)
        steps = steps_of_slice(pdf[pos].to_numpy(), pdf["n"].to_numpy(), int(start), window_us)
        return _to_frame(user, key, 0, int(start), steps)

    def join_steps(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        user, parent = group
        run = _from_frame(pdf)
        start = run[0][1]
        return _to_frame(user, key, int(parent), start, compose([steps for _, _, steps in run], start, window_us))

    def push_down(group: tuple, pdf: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        user = _value(group[0])
        start, count = None, 0
        if before is not None and not before.empty and not pd.isna(before["open_start"].iloc[0]):
            start, count = int(before["open_start"].iloc[0]), int(before["open_count"].iloc[0])
        rows = []
        for node, _, steps in _from_frame(pdf):
            rows.append((user, node, start, count))
            if start is not None:
                after = advance(steps, np.array([start]), np.array([count]), window_us)
                start, count = int(after[0][0]), int(after[1][0])
            elif len(steps.entry):
                start, count = int(steps.exit[0]), int(steps.tail[0])
        frame = pd.DataFrame(rows, columns=[key, "node", "open_start", "open_count"])
        return frame.astype({"open_start": "Int64"})

    def push_down_from(group: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[key, "node", "open_start", "open_count"])
        return push_down(group, pdf, before)

    # Slices get consecutive numbers per key; there are at most max_slices of them.
    first = cut_lineage(points.groupBy(key, SLICE).applyInPandas(slice_steps, table))
    numbered = (
        first.select(key, "start")
        .distinct()
        .withColumn("node", F.row_number().over(Window.partitionBy(key).orderBy("start")).cast("bigint") - 1)
    )
    levels = [cut_lineage(join_on(first.drop("node"), numbered, [key, "start"]).select(*table.names))]
    width = FAN_IN
    while width < slices.max_slices:
        grouped = levels[-1].withColumn("parent", F.call_function("div", "node", F.lit(FAN_IN)))
        levels.append(cut_lineage(grouped.groupBy(key, "parent").applyInPandas(join_steps, table)))
        width *= FAN_IN

    # The topmost nodes are few enough for one group per key, with no window before them.
    states = levels[-1].groupBy(key).applyInPandas(lambda group, pdf: push_down(group, pdf), state)
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.call_function("div", "node", F.lit(FAN_IN)))
        parents = states.withColumnRenamed("node", "parent")
        states = (
            children.groupBy(key, "parent").cogroup(parents.groupBy(key, "parent")).applyInPandas(push_down_from, state)
        )
    return join_on(states, numbered, [key, "node"]).select(
        key, F.col("start").alias(SLICE), "open_start", "open_count"
    )
