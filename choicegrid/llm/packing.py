"""Concatenate and cut: all documents side by side, cut into windows of a fixed number of ids.

Two passes. The first encodes every document, notes its place within its partition and keeps the ids as a table in the
shared folder. The totals of the partitions, one row each, give every partition its global offset. The second pass
cuts at the window bounds and gives one boundary record per piece. No document is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encode_texts, slices, vocabulary

SEQUENCE = 2048
END_ID = 1


def encode_documents(docs: DataFrame, vocab_path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, part, start, n, ids of every row of docs (doc_id, text), written in the shared folder.

    ids holds unsigned 16-bit little-endian ids where the vocabulary has fewer than 65,536, else 32-bit ones; start is the
    number of ids before the row in its partition. A null or empty text has no ids but end_id. Rows that repeat are kept.
    """

    def encode(batches):
        vocab = vocabulary(vocab_path)
        kind = np.dtype("<u2" if vocab.size <= 65536 else "<u4")
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole):
                ids, begins = encode_texts(vocab, batch.column(1))
                n = np.diff(begins)
                if end_id is not None:
                    ids = np.insert(ids, begins[1:], end_id)
                    n = n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                data = pa.py_buffer(ids.astype(kind).tobytes())
                blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((ends * kind.itemsize).astype(np.int64).tobytes()), data])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(start + ends[:-1], pa.int64()), pa.array(n, pa.int64()), blobs.cast(pa.binary())],
                    names=["doc_id", "part", "start", "n", "ids"],
                )
                start += int(ends[-1])

    return materialize(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, start long, n long, ids binary"))


def global_offsets(encoded: DataFrame) -> DataFrame:
    """part, offset, all_ids: ids before each partition and in all. One row per partition, so the running sum and its broadcast stay small."""
    totals = encoded.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    order = Window.orderBy("part")
    return totals.select(
        "part",
        F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_ids"),
    )


def pieces(encoded: DataFrame, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One boundary record per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, padded_length.

    Every id of encoded lies in exactly one piece. All sequences are full but the last, which is padded to sequence unless
    its length is a power of two. with_ids adds the ids of each piece as bytes of unsigned 32-bit numbers.
    """
    placed = encoded.join(F.broadcast(global_offsets(encoded)), "part")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, all_ids long"

    def cut(batches):
        for batch in batches:
            doc_ids, n, at, blobs, all_ids = (batch.column(i) for i in range(5))
            n, at = np.asarray(n, np.int64), np.asarray(at, np.int64)
            rows, of = [], []
            for i in range(batch.num_rows):
                length, place = int(n[i]), int(at[i])
                if not length:
                    continue
                blob = blobs[i].as_py()
                ids = np.frombuffer(blob, f"<u{len(blob) // length}").astype("<u4").tobytes()
                done = 0
                while done < length:
                    room = min(sequence - (place + done) % sequence, length - done)
                    own = ids[4 * done : 4 * (done + room)]
                    of.append(i)
                    rows.append((done, room, zlib.crc32(own), length, (place + done) // sequence, (place + done) % sequence, *([own] if with_ids else [])))
                    done += room
            if rows:
                names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
                columns = [pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)]
                columns.insert(6, all_ids.take(pa.array(of)))
                names.insert(6, "all_ids")
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(of)), *columns], names=["doc_id", *names])

    at = (F.col("offset") + F.col("start")).alias("at")
    cut_up = placed.select("doc_id", "n", at, "ids", "all_ids").mapInArrow(cut, schema + (", ids binary" if with_ids else ""))
    left = F.col("all_ids") - F.col("sequence_id") * sequence
    length = F.least(F.lit(sequence).cast("long"), left)
    return (
        cut_up.withColumn("sequence_length", length)
        .withColumn("padded_length", F.when(F.bit_count("sequence_length") == 1, F.col("sequence_length")).otherwise(sequence).cast("long"))
        .drop("all_ids")
    )


def pack(docs: DataFrame, vocab_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Boundary records of all documents packed into sequences of at most `sequence` ids.

    docs has doc_id and text; other columns are ignored. Null doc_ids and repeated rows are packed like any other row;
    an empty table gives no records.
    """
    return pieces(encode_documents(docs, vocab_path, end_id), sequence)


def sequences(records: DataFrame) -> DataFrame:
    """sequence_id, ids (array<int>), doc_ids, lengths: the sequences themselves, from pieces(..., with_ids=True).

    A group is one sequence, so it never holds more than the window's ids.
    """
    gathered = records.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))

    def read(batches):
        for batch in batches:
            flat = [np.concatenate([np.frombuffer(x["ids"], "<u4") for x in row]).astype(np.int32) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.int32())), *batch.columns[2:]], names=["sequence_id", "ids", "doc_ids", "lengths"])

    return gathered.select("sequence_id", "p", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")).mapInArrow(
        read, "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<long>"
    )
