"""Byte-level BPE ids of whole Arrow batches.

A text is cut at single spaces between two visible characters; no pre-token of the vocabulary's pattern crosses such a
space, so the ids of a text are the ids of its chunks put side by side. Each distinct chunk of a batch is then encoded once.
At other spaces (two in a row, one at a line's end or at the text's) nothing is cut, so a chunk may hold white space within.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern and Python see it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that isn't cut at: beside other white space, or at an end of the text.
UNSAFE = rf"{_SPACE} | {_SPACE}|^ | $"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that a slice of a batch holds at most, unless one text alone has more.
SLICE_CHARS = 8_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 letters for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers file of the byte-level BPE kind: encoding by its ranks, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if [model["vocab"][m.replace(" ", "")] for m in merged] != sorted(model["vocab"][m.replace(" ", "")] for m in merged):
            raise ValueError("merges must be listed in the order of their ids")
        self.size = max([*model["vocab"].values(), *special.values()]) + 1
        pieces = [b""] * self.size
        for w, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            pieces[i] = w
        self.pieces = pa.array(pieces, pa.binary())
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.special = set(special)
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype(np.int32)

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks side by side, each read as if a space stood before it, and where each chunk's ids begin."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids = self.encode(" " + joined(chunks))
        ends = np.cumsum(np.asarray(pc.binary_length(chunks), np.int64) + 1)
        read = np.cumsum(self.lengths[ids])
        at = np.searchsorted(read, ends, "left") + 1
        return ids, np.concatenate([[0], at])


def joined(chunks: pa.Array) -> str:
    """All chunks with a space between them."""
    chunks = chunks.cast(pa.large_string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(" ", pa.large_string()))[0].as_py()


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path or default_vocabulary())


@lru_cache(maxsize=2)
def library(path: str | None) -> Tokenizer:
    """The tokenizers library's own reading of the file, to test against."""
    return Tokenizer.from_file(path or default_vocabulary())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (length of them) for each pair, side by side."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_CHARS):
    """Parts of a batch whose texts have at most budget bytes in all, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    begin = taken = 0
    for i, n in enumerate(sizes.tolist()):
        if taken + n > budget and i > begin:
            yield batch.slice(begin, i - begin)
            begin, taken = i, 0
        taken += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts in order, first chunk's place of each text and the end); a null or empty text is one empty chunk."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern(texts, " ")
    bad = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, UNSAFE), bool))
    flat, ends = parts.flatten(), np.asarray(parts.offsets, np.int64)
    ends = ends - ends[0]
    if not len(bad):
        return flat, ends
    counts, pieces, at = np.diff(ends), [], 0
    for i in bad.tolist():  # texts with an unsafe space are cut one by one
        own = _CUT.split(texts[i].as_py())
        pieces += [flat.slice(at, int(ends[i]) - at), pa.array(own, pa.large_string())]
        counts[i], at = len(own), int(ends[i + 1])
    return pa.concat_arrays([*pieces, flat.slice(at)]), np.concatenate([[0], np.cumsum(counts)])


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """(distinct chunks, code of each chunk in order, first chunk's place of each text and the end, whole strings).

    Codes from len(distinct) on stand for the whole strings, which have no space before them: the first chunk of each text.
    """
    flat, ends = cut(texts)
    coded = pc.dictionary_encode(flat)
    chunks, codes = coded.dictionary, np.asarray(coded.indices, np.int64).copy()
    n = len(ends) - 1
    first = pc.take(flat, pa.array(ends[:-1])).to_pylist()
    codes[ends[:-1]] = len(chunks) + np.arange(n)
    used = np.zeros(len(chunks) + n, bool)
    used[codes] = True
    names = np.cumsum(used) - 1
    return chunks.filter(pa.array(used[: len(chunks)])), names[codes], ends, first


#: Chunks whose ids a Python worker keeps: the most frequent of the first texts that it meets. It changes no result.
CACHED_CHUNKS = 200_000


class ChunkCache:
    """Frequent chunks and their ids, so that only rare chunks are encoded anew in each batch."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.chunks, self.ids = vocab, None, None

    def fill(self, flat: pa.Array) -> None:
        counted = pc.value_counts(flat)
        order = pc.sort_indices(counted.field("counts"), sort_keys=[("", "descending")])[:CACHED_CHUNKS]
        self.chunks = pc.take(counted.field("values"), order)
        self.ids = id_lists(*self.vocab.encode_chunks(self.chunks))


def id_lists(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(ids, pa.int32()))


def encode_texts(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side (int32), and where each text's ids begin, with the end. A null text has none."""
    if not len(texts):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    cache = _cache(vocab)
    flat, ends = cut(texts)
    n = len(ends) - 1
    # a text's first chunk is read as it is; all others begin with a visible character, so none runs into the one before it
    inner = np.ones(len(flat), bool)
    inner[ends[:-1]] = False
    if cache.chunks is None:
        cache.fill(flat.filter(pa.array(inner)))
    known = pc.index_in(flat, value_set=cache.chunks)
    missing = np.flatnonzero(np.asarray(pc.is_null(known)) & inner)
    codes = np.asarray(pc.fill_null(known, 0), np.int64)
    rare = pc.dictionary_encode(pc.take(flat, pa.array(missing)))
    codes[missing] = len(cache.chunks) + np.asarray(rare.indices, np.int64)
    own = [vocab.encode(w) for w in pc.take(flat, pa.array(ends[:-1])).to_pylist()]
    codes[ends[:-1]] = len(cache.chunks) + len(rare.dictionary) + np.arange(n)
    lists = pa.concat_arrays([cache.ids, id_lists(*vocab.encode_chunks(rare.dictionary)), id_lists(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))])
    taken = pc.take(lists, pa.array(codes))
    begins = np.asarray(taken.offsets, np.int64)
    return np.asarray(taken.flatten()), (begins - begins[0])[ends]


_caches: dict[int, ChunkCache] = {}


def _cache(vocab: Vocabulary) -> ChunkCache:
    return _caches.setdefault(id(vocab), ChunkCache(vocab))
