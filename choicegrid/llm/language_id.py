"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts cover every document outside the held-out fold that has a language. Each task adds its counts up before the
shuffle, so a task sends a row per language and bucket. The log-probability matrix has languages x buckets numbers, whatever
the data's size; it is broadcast, LANGUAGES columns at a time. Texts are cut into pieces of bounded length, and a piece is
scored as a sparse row: its distinct buckets and how often they occur, times the matrix. Sums of pieces add up to a text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize
from .tokens import slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Languages that are scored at once: their matrix has LANGUAGES * 3 * BUCKETS * 4 bytes at most. More take further passes.
LANGUAGES = 128
#: Code points of a piece of a text, and of the pieces that are read at once, about.
PIECE = 250_000
#: Numbers of the matrix that are gathered at once, and languages that a task counts before it hands them on.
GATHERED, COUNTED = 4_000_000, 32
SLICE = 2_000_000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-case letters as code points with 0 for anything else, the text of each, whether it counts) of pieces of all texts.

    A text of more than PIECE code points is cut; a piece begins with the last code points before it, which don't count.
    Zeros stand between pieces, so no n-gram reaches into another text; those after a text's end count.
    """
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    gap = max(ORDERS) - 1
    held: list[tuple[str, int, int, bool]] = []
    n = 0

    def read():
        data = np.frombuffer(("\n" * gap).join(["", *(t for t, *_ in held), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([gap, *(len(t) + gap for t, *_ in held)])
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins, ends = np.array([gap, *(c for *_, c, _ in held)]), np.array([gap, *(len(t) + gap * last for t, *_, last in held)])
        counts = (place >= np.repeat(begins, sizes)) & (place < np.repeat(ends, sizes))
        return np.where(_letters()[data], data, 0).astype(np.int64), np.repeat([held[0][1], *(d for _, d, *_ in held)], sizes), counts

    for doc, value in enumerate(texts):
        text = value.as_py() or ""
        for begin in range(0, max(len(text), 1), PIECE):
            context = min(begin, gap)
            held.append((text[begin - context : begin + PIECE], doc, context, begin + PIECE >= len(text)))
            n += len(held[-1][0]) + gap
            if n >= PIECE:
                yield read()
                held, n = [], 0
    if held:
        yield read()


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place; n-grams of nothing but non-letters share bucket 0 and count nothing."""
    value = codes.copy()
    for back in range(1, order):
        value[back:] = value[back:] * 1_000_003 + codes[:-back]
    mixed = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(value == 0, 0, 1 + (mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1)) + (order - 1) * BUCKETS


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of docs (text, lang)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def handed():
            for lang, held in total.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at])], names=["lang", "bucket", "n"])
            total.clear()

        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                langs = batch.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    if lang not in total and len(total) >= COUNTED:
                        yield from handed()
                    held = total.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    for codes, _, counts in pieces(batch.column(0).filter(pa.array([x == lang for x in langs]))):
                        for order in ORDERS:
                            held += np.bincount(buckets(codes, order)[counts], minlength=len(held))
        yield from handed()

    return docs.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log priors and log probabilities (buckets x languages) of some languages."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.langs, self.prior, self.matrix = langs, prior, matrix

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log joint probability of each text and language, whether the text has a letter)."""
        out, letter = np.tile(self.prior, (len(texts), 1)).astype(float), np.zeros(len(texts), bool)
        step = max(1, GATHERED // max(len(self.langs), 1))
        for codes, docs, counts in pieces(texts):
            letter[docs[codes > 0]] = True
            first = int(docs[0])
            for order in ORDERS:
                bucket = buckets(codes, order) - (order - 1) * BUCKETS
                used = counts & (bucket > 0)
                keys = np.sort((docs[used] - first) * BUCKETS + bucket[used])
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
                times, keys = np.diff(np.append(at, len(keys))), keys[at]
                for begin in range(0, len(keys), step):  # the rows' sparse product with the matrix
                    k, n = keys[begin : begin + step], times[begin : begin + step]
                    weighed = self.matrix[k % BUCKETS + (order - 1) * BUCKETS] * n[:, None].astype(np.float32)
                    row = k // BUCKETS
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    out[first + row[starts]] += np.add.reduceat(weighed, starts, axis=0, dtype=np.float64)
        return out, letter

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's place, its posterior among these languages, whether the text has a letter)."""
        sums, letter = self.sums(texts)
        return sums.argmax(axis=1), 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), letter


def languages(docs: DataFrame) -> list[tuple[str, int]]:
    """Languages of docs (lang) and their documents, by name; one row per language reaches the driver."""
    return [(r["lang"], r["count"]) for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy("lang").collect()]


def fit(docs: DataFrame, smoothing: float = 0.5, among: list[tuple[str, int]] | None = None, all_docs: int | None = None) -> Model | None:
    """Model of docs (text, lang) for the languages `among` (default: all; at most LANGUAGES), with the prior in all_docs documents.

    Rows without a language count nothing; None where there is no language.
    """
    among = languages(docs) if among is None else among
    if not among:
        return None
    if len(among) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages at once")
    place = {x: i for i, (x, _) in enumerate(among)}
    counts = np.zeros((len(ORDERS) * BUCKETS, len(among)))
    found = count_ngrams(docs.where(F.col("lang").isin(list(place)))).toArrow()  # at most languages x buckets rows
    counts[np.asarray(found["bucket"]), np.array([place[x] for x in found["lang"].to_pylist()], int)] = np.asarray(found["n"])
    matrix = np.zeros(counts.shape, np.float32)
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS + 1 : (k + 1) * BUCKETS] + smoothing
        matrix[k * BUCKETS + 1 : (k + 1) * BUCKETS] = np.log(part / part.sum(axis=0))
    n = np.array([c for _, c in among], float)
    return Model(list(place), np.log(n / (all_docs or n.sum())), matrix)


def compare(state: DataFrame, model: Model) -> DataFrame:
    """state (doc_id, text, lang_pred, best, total) after the languages of model: the best so far, its log joint probability, all of them summed."""
    held = state.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                sums, letter = model.sums(batch.column(1))
                at, best, total = sums.argmax(axis=1), np.asarray(batch.column(3)), np.asarray(batch.column(4))
                top = sums.max(axis=1)
                total = np.logaddexp(total, top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
                pred = [(model.langs[a] if t > b else old) if k else UNDETERMINED for a, t, b, old, k in zip(at.tolist(), top.tolist(), best.tolist(), batch.column(2).to_pylist(), letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.maximum(top, best)), pa.array(total)], names=batch.schema.names)

    return state.mapInArrow(run, "doc_id long, text string, lang_pred string, best double, total double")


def predict(docs: DataFrame, train: DataFrame, block: int = LANGUAGES) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text), learned from train (text, lang).

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing could be learned. Ties go to the
    language that sorts first. Rows that repeat are scored each; other columns are ignored. Long texts are read piece by
    piece. Beyond `block` languages each further block is a pass over docs, whose state is kept as a table.
    """
    among = languages(train)
    all_docs = sum(n for _, n in among)
    least = F.lit(float("-inf"))
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNDETERMINED).alias("lang_pred"), least.alias("best"), least.alias("total"))
    for begin in range(0, len(among), block):
        state = materialize(state) if begin else state
        state = compare(state, fit(train, among=among[begin : begin + block], all_docs=all_docs))
    score = F.when(F.col("lang_pred") == UNDETERMINED, 0.0).otherwise(F.exp(F.col("best") - F.col("total")))
    return state.select("doc_id", "lang_pred", score.alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of docs outside the held-out fold."""
    return predict(docs, docs.where(~held_out(F.col("doc_id")))).withColumn("held_out", held_out(F.col("doc_id")))
