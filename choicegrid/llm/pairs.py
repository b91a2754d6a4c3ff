"""Many small groups of rows at once: Arrow batches of whole groups, and the pairs within them.

Rows come sorted by the group's keys, so a task streams through its groups and never calls Python once per group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_keyed
from .common import materialize


def blocked(members: DataFrame, keys: list[str], member: str, size: str, block: int) -> DataFrame:
    """members once per pair of blocks of its group: adds i, j (the pair, i <= j) and own (the member's block).

    size is an aggregate of a group's rows; a group has about size / block blocks, to which a hash of the member deals its
    rows, so no pair of blocks is much larger than 2 * block however large the group is. Groups of one row are left out.
    """
    sizes = materialize(members.groupBy(*keys).agg(F.count("*").alias("__rows"), F.expr(size).alias("__size")).where("__rows > 1"))
    # rows of large groups learn its size by a broadcast, so none of them meets in one task before it is dealt
    dealt = join_keyed(members, sizes, keys, "__rows").withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.col("__size") / block)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member, F.lit(3)), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    return dealt.withColumn("__o", other).withColumn("i", F.least("own", "__o")).withColumn("j", F.greatest("own", "__o")).drop("__o", "__size", "__blocks")


def dealt_groups(rows: DataFrame) -> DataFrame:
    """rows (name, i, j and others) with every group of (name, i, j) side by side in one partition."""
    return rows.repartition("name", "i", "j").sortWithinPartitions("name", "i", "j")


def whole_groups(batches: Iterable[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, number of each row's group) of whole groups of (name, i, j), about `rows` rows at a time."""
    held, n = [], 0

    def numbered(table: pa.Table) -> np.ndarray:
        keys = np.column_stack([np.asarray(table[c], np.int64) for c in ("name", "i", "j")])
        return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            groups = numbered(table)
            last = int(np.searchsorted(groups, groups[-1]))
            if last:
                yield table.slice(0, last), groups[:last]
            held = table.slice(last).to_batches()
            n = table.num_rows - last
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbered(table)


def spans(groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """First place and end of each group."""
    at = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if len(groups) else np.zeros(1, int)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def close_pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places p < q of one group, at most one pair per place at a time."""
    at, shift = np.arange(len(groups)), 1
    while True:
        at = at[at + shift < len(groups)]
        at = at[groups[at] == groups[at + shift]]
        if not len(at):
            return
        yield at, at + shift
        shift += 1


def spanning(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that each of n places reaches by the edges."""
    label = np.arange(n)
    while edges:
        before = label.copy()
        for a, b in edges:
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label
