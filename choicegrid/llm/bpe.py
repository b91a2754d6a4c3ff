"""Byte-level BPE through a table of distinct words.

1. Texts are split into words (what a single space sets apart) in blocks of documents; a block keeps its distinct words and,
   for every document, the numbers of its words in order.
2. Distinct words of all blocks meet by a hash of the word, in as many buckets as the number of distinct words asks for. A
   bucket's rows stream by, and each of its words is encoded once, whatever number of blocks ask for it.
3. Answers go back to their blocks, where ids take the place of the words by position.

Words of a block travel packed, one row per block and hash bucket, since rows of single words would shuffle several times
the input. A frequent word is one entry per block, so no bucket grows with its frequency. Decoding looks ids up in the
id-to-piece table, whose size is the vocabulary's, and joins the pieces' bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import slices, split_texts, vocabulary

#: Bytes of text of a block, about.
BLOCK_BYTES = 6_000_000
#: Distinct words of a bucket, about. The number of buckets grows with the distinct words and not with the text, so a block's
#: words are cut into no more rows because there are more blocks.
BUCKET_WORDS = 100_000
#: Words that are answered at once, about.
ASKED_WORDS = 300_000
#: Ids that are decoded at once, about; it bounds a task's memory.
DECODED_IDS = 300_000
#: Most frequent words of a block that get the smallest numbers; it only makes blocks smaller.
LEADING = 4096


def pack(**arrays: pa.Array) -> bytes:
    """Arrow arrays as compressed bytes; each is a row of lists, so they may differ in length."""
    row = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), a) for a in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return zstandard.compress(sink.getvalue(), 3)


def unpack(blob: bytes) -> dict[str, pa.Array]:
    with pa.ipc.open_stream(zstandard.decompress(blob)) as source:
        row = source.read_next_batch()
    return {name: column.flatten() for name, column in zip(row.schema.names, row.columns, strict=True)}


def planes(numbers: np.ndarray) -> pa.Array:
    """Unsigned 32-bit numbers, all first bytes, then all second ones, and so on: alike bytes compress better side by side."""
    return pa.array(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel())


def unplanes(stored: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(stored).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def word_blocks(docs: DataFrame, buckets: int, words: bool) -> DataFrame:
    """block, bucket, data: the distinct words of each block by bucket or, unless words, its documents as numbers of words in bucket -1.

    Numbers count the block's words in the order of their buckets, words with a space before them first, then whole strings.
    Both halves name the block by its place in the input and carry a digest of its words, which must agree.
    """

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, budget=BLOCK_BYTES):
                chunks, codes, ends, strings = split_texts(batch.column(1))
                items = pa.concat_arrays([chunks.cast(pa.large_string()), pa.array(strings, pa.large_string())])
                inner = np.arange(len(items)) < len(chunks)
                names = items.to_pylist()
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names), np.int64, len(names))
                rank = np.empty(len(items), np.int64)
                rank[np.asarray(pc.sort_indices(items))] = np.arange(len(items))
                order = np.lexsort((rank, ~inner, bucket))  # words that begin alike compress better side by side
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                counts = np.bincount(codes, minlength=len(items))
                leading = np.argsort(-counts, kind="stable")[:LEADING]
                number = place + len(leading)
                number[leading] = np.arange(len(leading))
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                mark = xxhash.xxh3_64_intdigest(b"".join(x for x in items.take(pa.array(order)).buffers()[1:] if x is not None)) >> 1
                rows = []
                if not words:
                    rows.append((-1, pack(doc_id=batch.column(0), ends=pa.array(ends), numbers=planes(number[codes]), leading=pa.array(place[leading]), mark=pa.array([mark]))))
                for k in np.flatnonzero(np.diff(bounds)).tolist() if words else ():
                    own = order[bounds[k] : bounds[k + 1]]
                    split = int(inner[own].sum())
                    rows.append((k, pack(chunks=items.take(pa.array(own[:split])), wholes=items.take(pa.array(own[split:])), mark=pa.array([mark]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())],
                    names=["block", "bucket", "data"],
                )
                block += 1

    return docs.select("doc_id", "text").mapInArrow(run, "block long, bucket int, data binary")


class Words:
    """Words of a bucket that were encoded so far, with their ids."""

    def __init__(self, encode, kind: pa.DataType):
        self.encode, self.words, self.lists = encode, pa.array([], pa.large_string()), pa.array([], pa.large_list(kind))

    def ids(self, words: pa.Array) -> pa.Array:
        """A list of ids for each word; words that are new are encoded, once each."""
        coded = pc.dictionary_encode(words)
        found = pc.index_in(coded.dictionary, value_set=self.words)
        new = coded.dictionary.filter(pc.is_null(found))
        if len(new):
            ids, begins = self.encode(new)
            self.words = pa.concat_arrays([self.words, new])
            self.lists = pa.concat_arrays([self.lists, pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(ids).cast(self.lists.type.value_type))])
            found = pc.index_in(coded.dictionary, value_set=self.words)
        return pc.take(self.lists, pc.take(found, coded.indices))


def same_bucket(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[int], list[dict]]]:
    """(bucket, blocks, their unpacked rows) of rows in the order of their buckets, about `most` words at a time."""
    at, blocks, held, n = None, [], [], 0
    for batch in batches:
        for block, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and (bucket != at or n >= most):
                yield at, blocks, held
                blocks, held, n = [], [], 0
            row = unpack(data.as_py())
            at, n = bucket, n + len(row["chunks"]) + len(row["wholes"])
            blocks.append(block)
            held.append(row)
    if held:
        yield at, blocks, held


def encode_words(asked: DataFrame, vocab_path: str | None) -> DataFrame:
    """The rows of asked with the ids of their words in place of them; each distinct word of a bucket is encoded once."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        kind = pa.uint16() if vocab.size <= 65536 else pa.uint32()

        def one_by_one(words):
            own = [vocab.encode(w) for w in words.to_pylist()]
            return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

        at, known = None, {}
        for bucket, blocks, rows in same_bucket(batches, ASKED_WORDS):
            if bucket != at:
                at, known = bucket, {"chunks": Words(vocab.encode_chunks, kind), "wholes": Words(one_by_one, kind)}
            answers = {name: own.ids(pa.concat_arrays([r[name] for r in rows])) for name, own in known.items()}
            out, done = [], dict.fromkeys(known, 0)
            for r in rows:
                parts = []
                for name in known:
                    parts.append(answers[name].slice(done[name], len(r[name])))
                    done[name] += len(r[name])
                both = pa.concat_arrays(parts)
                out.append(pack(ids=both.flatten(), lengths=pc.list_value_length(both).cast(pa.int32()), mark=r["mark"]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, data binary")


def distinct_words(docs: DataFrame) -> int:
    """How many words are different, about."""
    return docs.select(F.explode(F.split("text", " ")).alias("w")).agg(F.approx_count_distinct("w")).first()[0]


def encode(docs: DataFrame, vocab_path: str | None = None, buckets: int | None = None, from_files: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of every row of docs (doc_id, text), as the tokenizers library encodes it without adding special tokens.

    A null text counts as empty and has no ids; special tokens written out in a text are read as such. Rows that repeat and
    null doc_ids are kept; an empty table gives no rows. Blocks are cut twice, once for their words and once for their
    documents, so docs must have the same rows in the same order each time: from_files says that it is read from files as
    they are, else it is written as a table first. Blocks that don't agree fail the query.
    """
    docs = docs.select("doc_id", "text") if from_files else materialize(docs.select("doc_id", "text"))
    if buckets is None:
        buckets = max(1, -(-distinct_words(docs) // BUCKET_WORDS))
    answers = encode_words(word_blocks(docs, buckets, True), vocab_path)

    def assemble(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        sequence, *found = [unpack(d) for d in table["data"].to_pylist()]
        if table["bucket"][0].as_py() != -1 or any(x["mark"] != sequence["mark"] for x in found):
            raise ValueError("a block's words and documents were read from different rows")
        lengths = np.concatenate([np.asarray(x["lengths"], np.int64) for x in found]) if found else np.zeros(0, np.int64)
        ids = pa.concat_arrays([x["ids"] for x in found]).cast(pa.int32()) if found else pa.array([], pa.int32())
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64()), ids)
        leading, numbers = np.asarray(sequence["leading"], np.int64), unplanes(sequence["numbers"])
        early = numbers < len(leading)
        place = numbers - len(leading)
        place[early] = leading[numbers[early]]
        taken = pc.take(lists, pa.array(place))
        begins = np.asarray(taken.offsets, np.int64)
        ends = (begins - begins[0])[np.asarray(sequence["ends"], np.int64)]
        return pa.table({"doc_id": sequence["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten())})

    return word_blocks(docs, buckets, False).unionByName(answers).groupBy("block").applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every row of encoded (doc_id, ids): the pieces of the ids joined, special tokens included.

    Bytes that aren't UTF-8 become U+FFFD. Null ids give a null; an id beyond the vocabulary is an error.
    """

    def run(batches):
        vocab = vocabulary(vocab_path)
        pieces = vocab.pieces.cast(pa.large_binary())
        for whole in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(whole.column(1)), 0), np.int64)
            part = np.cumsum(sizes) // DECODED_IDS
            for begin in np.unique(part, return_index=True)[1].tolist():
                batch = whole.slice(begin, int((part == part[begin]).sum()))
                ids, n = batch.column(1), sizes[begin : begin + batch.num_rows]
                flat = ids.flatten()
                data = memoryview(pc.take(pieces, flat).buffers()[2] or b"")
                at = np.concatenate([[0], np.cumsum(vocab.lengths[np.asarray(flat)])])[np.concatenate([[0], np.cumsum(n)])]
                texts = [bytes(data[a:b]).decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str | None = None, from_files: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    both = decode(encode(docs, vocab_path, from_files=from_files), vocab_path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
