"""Joins of large tables with key lists that are usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_VALUES = 1_000_000  # numbers in a list that is broadcast: 8 MB, some 30 MB as a hash table


def broadcast_if_small(listed: DataFrame, values_per_row: int = 1, values: int | None = None) -> DataFrame:
    """``listed``, a written table of numbers, for broadcast if it is counted to be small enough.

    Beyond the bound it is joined like any table. ``values``: how many numbers it has, where its
    rows hold arrays; else they are ``values_per_row`` a row.
    """
    n = listed.count() * values_per_row if values is None else values
    return F.broadcast(listed) if n <= BROADCAST_VALUES else listed
