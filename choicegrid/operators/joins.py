"""Joins of rows with one row per key, whatever share of the rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is a hot one, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with keyed, which has one row per key and in count how many rows have it (column count is dropped).

    Of n rows fewer than n / m have a key that more than m rows share, so there are fewer than HOT_KEYS hot keys; they are
    broadcast, and only rows of other keys are shuffled.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.where(F.col(count) > most).drop(count))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(count) <= most).drop(count), keys)
    return rows.join(hot, keys).unionByName(rest)
