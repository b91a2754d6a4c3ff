"""Supervised data sets of transcripts: text to tokens, labels where a choice is, batches padded to their own width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import supervision as sv
from ..schemas import SESSION
from .sampling import split_train_eval
from .scoring import Make, tokenized


def supervised_set(sessions: DataFrame, make: Make, most_tokens: int, side: str = "head", eval_fraction: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, eval): sessions with ids and labels in place of their text, cut to most_tokens at one side.

    labels repeats an id where a marked choice's token is and holds IGNORE elsewhere; sessions of which nothing is left to be
    learned are dropped. The split is by a hash of the session; with a fraction of 0 both parts are the whole.
    """
    parts = split_train_eval(sessions, SESSION, eval_fraction, seed)
    return tuple(labelled(part, make, most_tokens, side) for part in parts)


def labelled(sessions: DataFrame, make: Make, most_tokens: int, side: str = "head") -> DataFrame:
    rows = tokenized(sessions, make)
    labels = sv.supervised_labels(F.col("ids"), sv.tokens_of_spans(F.col("tokens"), F.col("spans")))
    rows = rows.withColumn("labels", labels).drop("tokens", "spans")
    cut = rows.withColumns({c: sv.truncated(F.col(c), most_tokens, side) for c in ("ids", "labels")})
    return cut.where(sv.has_supervision(F.col("labels")))


def runs_of(values: list) -> Iterator[tuple[int, int]]:
    """First place and end of each run of equal values."""
    begin = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[begin]:
            yield begin, k
            begin = k


def padded_batches(rows: DataFrame, size: int, pad_id: int, by: list[str]) -> DataFrame:
    """rows with partition, batch, width, attention, and ids and labels padded to width, the longest of the batch.

    A batch is up to `size` rows that follow each other in a partition with equal values in `by`; batches go on over Arrow
    batches, and a task holds one of them. by may be empty. ids are padded with pad_id, labels with IGNORE, attention with 0.
    """
    if size < 1:
        raise ValueError("size must be positive")
    ddl = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", partition int, batch long, width int, attention array<int>"
    columns_in = list(rows.columns)
    keys = [columns_in.index(c) for c in by]
    ids_at, labels_at = columns_in.index("ids"), columns_in.index("labels")

    def padded(lists: pa.Array, width: int, fill: int) -> pa.Array:
        out = np.full((len(lists), width), fill, np.int32)
        lengths = np.diff(np.asarray(lists.offsets))
        out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(lists.flatten(), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * width, pa.int32()), pa.array(out.ravel()))

    def run(batches):
        from pyspark import TaskContext

        number, held, key = 0, [], None

        def closed() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
            lengths = np.diff(np.asarray(columns[ids_at].offsets))
            width, n = int(lengths.max()), len(lengths)
            attention = padded(pa.ListArray.from_arrays(columns[ids_at].offsets, pa.array(np.ones(len(columns[ids_at].values), np.int32))), width, 0)
            columns[ids_at], columns[labels_at] = padded(columns[ids_at], width, pad_id), padded(columns[labels_at], width, sv.IGNORE)
            columns += [pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array([width] * n, pa.int32()), attention]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*columns_in, "partition", "batch", "width", "attention"])

        for batch in batches:
            values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            for begin, end in runs_of(values):
                if held and values[begin] != key:
                    yield closed()
                key = values[begin]
                while begin < end:
                    n = min(end - begin, size - sum(b.num_rows for b in held))
                    held.append(batch.slice(begin, n))
                    begin += n
                    if sum(b.num_rows for b in held) == size:
                        yield closed()
        if held:
            yield closed()

    return rows.mapInArrow(run, ddl)
