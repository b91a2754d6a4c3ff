"""Best-fit-decreasing packing into id matrices with cumulative segment lengths and position resets.

Documents are encoded, overlong ones are split into full rows and a rest without losing an id, and the rests of a chunk of
documents are placed in decreasing length, each into the fullest row that still has room. A segment tree over the
capacities 0..sequence finds that row in log2(sequence) steps. Each partition packs its own chunks, so nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encode_texts, slices, vocabulary

SEQUENCE = 2048
END_ID = 1
#: Ids that are packed together; it bounds a task's memory.
CHUNK_IDS = 4_000_000


class CapacityTree:
    """Rows by free capacity 0..top; finds the smallest capacity that is at least n and has a row."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) of a tightest row with room for n, which leaves the tree; None if there is none."""
        i = n + self.size
        if not self.count[i]:
            while True:  # climb until a right neighbour's subtree has a row
                if i == 1:
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], sequence: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length), for documents of the given lengths; each id is in exactly one segment."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for i, n in enumerate(lengths):
        full = n // sequence
        rows.extend([(i, k * sequence, sequence)] for k in range(full))
        if n % sequence:
            rests.append((i, full * sequence, n % sequence))
    tree = CapacityTree(sequence)
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        found = tree.take(piece[2])
        if found is None:
            rows.append([piece])
            found = sequence, len(rows) - 1
        else:
            rows[found[1]].append(piece)
        if found[0] > piece[2]:
            tree.add(found[0] - piece[2], found[1])
    return rows


SCHEMA = "part int, chunk int, row int, n_ids int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_crc32 long, input_ids binary, position_ids binary"


def pack_matrices(docs: DataFrame, vocab_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """One row per matrix row: part, chunk, row, n_ids, doc_ids, starts, cu_seqlens, ids_crc32, input_ids, position_ids.

    input_ids and position_ids are `sequence` little-endian numbers each (16 bits where the vocabulary and the sequence
    allow, else 32): the segments of doc_ids side by side, then pad_id. Positions count from 0 in every segment and are 0
    in the padding. cu_seqlens runs from 0 to n_ids; starts are the ids of the document before each segment. A null text
    counts as empty and gives end_id alone; repeated rows are packed each; an empty table gives no rows.
    """

    def emit(part, chunk, doc_ids, ids, begins, kind):
        out = []
        for row, segments in enumerate(best_fit_decreasing(np.diff(begins).tolist(), sequence)):
            taken = [ids[begins[i] + s : begins[i] + s + n] for i, s, n in segments]
            cu = np.concatenate([[0], np.cumsum([n for _, _, n in segments])])
            matrix, place = np.full(sequence, pad_id, kind), np.zeros(sequence, kind)
            matrix[: cu[-1]] = np.concatenate(taken)
            place[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
            out.append((part, chunk, row, int(cu[-1]), [doc_ids[i] for i, _, _ in segments], [s for _, s, _ in segments], cu.tolist(), zlib.crc32(matrix[: cu[-1]].astype("<u4").tobytes()), matrix.tobytes(), place.tobytes()))
        types = [pa.int32()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), types, strict=True)], names=names)

    def run(batches):
        vocab = vocabulary(vocab_path)
        kind = np.dtype("<u2" if vocab.size <= 65536 and sequence <= 65536 else "<u4")
        part, chunk = TaskContext.get().partitionId(), 0
        held_docs, held_ids, held = [], [], 0
        for whole in batches:
            for batch in slices(whole):
                ids, begins = encode_texts(vocab, batch.column(1))
                ids = np.insert(ids, begins[1:], end_id).astype(kind)
                begins = begins + np.arange(len(begins))
                held_docs.extend(zip(batch.column(0).to_pylist(), np.diff(begins).tolist(), strict=True))
                held_ids.append(ids)
                held += len(ids)
                if held >= CHUNK_IDS:
                    yield from emit(part, chunk, [d for d, _ in held_docs], np.concatenate(held_ids), np.concatenate([[0], np.cumsum([n for _, n in held_docs])]), kind)
                    held_docs, held_ids, held, chunk = [], [], 0, chunk + 1
        if held_docs:
            yield from emit(part, chunk, [d for d, _ in held_docs], np.concatenate(held_ids), np.concatenate([[0], np.cumsum([n for _, n in held_docs])]), kind)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Write pack_matrices(docs) as Parquet: matrices, cumulative lengths and positions side by side."""
    pack_matrices(docs, **options).write.mode("errorifexists").option("compression", "zstd").parquet(path)
