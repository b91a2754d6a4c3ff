"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

Both start from the same labelled rows. In each round each classifier labels the rows without a label that it is surest of,
and the other one learns from them. Then each view is calibrated on labelled rows that it has not been fitted on, the two
calibrated views are combined, and all documents are scored. Both views of every document are computed once and kept as
packed rows. A round is one pass over those of all documents without a label: a task keeps the surest rows that it meets,
and of these a bounded number reaches the driver. Models are fitted there, on a bounded sample of labelled rows and these.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, filter_rows, held_out, materialize
from .tokens import slices
from .training import Logistic, labelled_rows, with_labels

#: Labelled rows that the views are fitted on at most (about).
TRAIN_ROWS = 20_000
ROUNDS = 3
#: A classifier is sure above this probability, or below one minus it.
SURE = 0.97
#: Pseudo-labels that a classifier gives in a round at most, as a share of the labelled rows of that label.
GIVEN = 0.25
SLICE = 8_000_000
#: Hashed words of the content view, and hashed sources and languages of the metadata view.
WORDS, META_BUCKETS = 256, 96
RATIOS, STEPS = 16, 7
#: Numbers of each view.
CONTENT, METADATA = RATIOS + WORDS, 2 * META_BUCKETS + STEPS
#: What a document's views are packed into: all numbers but the zeros of the one-hot source and language.
PACKED = np.dtype([("ratios", "<f4", (RATIOS,)), ("words", "u1", (WORDS,)), ("source", "<u2"), ("lang", "<u2"), ("size", "<f4")])


def _byte_classes() -> np.ndarray:
    """0 other, 1 space, 2 line end, 3 digit, 4 upper-case letter, 5 lower-case letter, 6 mark of a sentence, 7 other symbol, 8 inside a character."""
    table = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = 2 if c == "\n" else 1 if c.isspace() else 3 if c.isdigit() else 4 if c.isupper() else 5 if c.isalpha() else 6 if c in ".,;:'-\"()?!" else 7 if b > 32 else 0
    table[128:192], table[192:] = 8, 5
    return table


def content_features(texts: pa.Array) -> np.ndarray:
    """Ratios within each text (kinds of characters, repeated words, lines and neighbours, lengths), then its hashed words.

    A hashed word is the square root of its share of the text's words, in steps of 1 / 255.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data = np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode(), np.uint8)
    sizes = np.asarray(pc.binary_length(texts), np.int64) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    kinds = _byte_classes()[data]
    n = [np.add.reduceat((kinds == k).astype(np.int32), begins).astype(float) for k in range(9)] if len(begins) else [np.zeros(0)] * 9
    chars = np.maximum(sizes - 1 - n[8], 1)
    n[2] = n[2] - 1
    pairs = np.add.reduceat(((kinds[:-1] == 7) & (kinds[1:] == 7)).astype(np.int32), np.minimum(begins, max(len(kinds) - 2, 0))).astype(float) if len(kinds) > 1 else np.zeros(len(begins))
    exclaim = np.add.reduceat((data == 33).astype(np.int32), begins).astype(float) if len(begins) else np.zeros(0)
    for mark in "\n\t":
        texts = pc.replace_substring(texts, mark, " ")
    parts = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(parts.flatten())
    ends = np.asarray(parts.offsets, np.int64)
    ends = ends - ends[0]
    counts = np.maximum(np.diff(ends), 1).astype(float)
    codes = np.asarray(coded.indices, np.int64)
    docs = np.repeat(np.arange(len(counts)), np.diff(ends))
    different = np.bincount(distinct((docs << 32) + codes) >> 32, minlength=len(counts))
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (docs[1:] == docs[:-1])])
    neighbours = np.bincount(docs[same], minlength=len(counts))
    inside = docs[1:] == docs[:-1]
    bigrams = ((codes[:-1].astype(np.uint64) << np.uint64(32)) + codes[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    two = np.bincount(distinct((docs[1:][inside] << 40) + bigrams[inside].astype(np.int64)) >> 40, minlength=len(counts))
    per = lambda x: x / chars
    columns = [
        np.sqrt(per(n[7])), np.sqrt(per(pairs)), np.sqrt(per(n[3])), np.sqrt(per(n[4])), per(n[5]), np.sqrt(per(n[6])), np.sqrt(per(exclaim)), per(n[1] + n[2]), np.sqrt(per(n[2])),
        np.log1p(chars), np.log(counts), np.sqrt(neighbours / counts), different / counts, two / np.maximum(counts - 1, 1), chars / counts, (different / counts) * np.log(counts),
    ]
    place = np.array([xxhash.xxh32_intdigest(w) % WORDS for w in coded.dictionary.to_pylist()], np.int64)
    words = np.bincount(docs * WORDS + place[codes], minlength=len(counts) * WORDS).reshape(-1, WORDS) if len(codes) else np.zeros((len(counts), WORDS))
    return np.column_stack([np.nan_to_num(np.column_stack(columns)), np.rint(255 * np.sqrt(words / counts[:, None])) / 255])


def _hashed(column: pa.Array) -> np.ndarray:
    coded = pc.dictionary_encode(pc.fill_null(column, "\x00"))
    place = np.array([xxhash.xxh32_intdigest(x) % META_BUCKETS for x in coded.dictionary.to_pylist()], np.uint16)
    return place[np.asarray(coded.indices)] if len(column) else np.zeros(0, np.uint16)


def pack(batch: pa.RecordBatch) -> np.ndarray:
    """Both views of (doc_id, text, source, lang, n_chars): a null source or language has a bucket of its own, a null length is 0."""
    out = np.zeros(batch.num_rows, PACKED)
    content = content_features(batch.column(1))
    out["ratios"], out["words"] = content[:, :RATIOS], np.rint(content[:, RATIOS:] * 255)
    out["source"], out["lang"] = _hashed(batch.column(2)), _hashed(batch.column(3))
    out["size"] = np.log1p(np.maximum(np.asarray(pc.fill_null(batch.column(4), 0), float), 0))
    return out


def unpack(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content, metadata) of packed rows: ratios and hashed words; hashed source and language, and the stated length."""
    content = np.column_stack([rows["ratios"].astype(float), rows["words"] / 255])
    meta = np.zeros((len(rows), METADATA))
    at = np.arange(len(rows))
    meta[at, rows["source"]] = 1
    meta[at, META_BUCKETS + rows["lang"].astype(int)] = 1
    meta[:, -STEPS] = rows["size"]
    for i, edge in enumerate((5, 6, 7, 8, 9, 10)):
        meta[:, -STEPS + 1 + i] = rows["size"] > edge
    return content, meta


def _read(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), PACKED)


def input_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs that the views read; missing ones are null."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def inputs(docs: DataFrame) -> DataFrame:
    return docs.select(*input_columns(docs))


class Model:
    """Both views' classifiers, their calibrations and what combines them; base is the score where nothing was learned."""

    def __init__(self, base: float):
        self.base, self.views, self.calibrations, self.combined = base, None, None, None

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(content), self.base)
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (content, meta), strict=True)]
        return self.combined.proba(np.column_stack(logits))


def packed_views(docs: DataFrame) -> DataFrame:
    """uid, doc_id, x of every row of docs, written as a table; uid is a number of the row, x its packed views."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in pack(batch)], pa.binary())], names=["doc_id", "x"])

    return materialize(inputs(docs).mapInArrow(run, "doc_id long, x binary").withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "x"))


#: What a view offers: uid, label and packed views of rows that it is sure of.
Offer = tuple[np.ndarray, np.ndarray, np.ndarray]


def surest(pool: DataFrame) -> Callable[[list[Logistic], list[np.ndarray], tuple[int, int]], list[Offer]]:
    """What asks all rows of pool (uid, x) for the surest: for each view and label at most so many that it hasn't given before.

    Ties go to the least uid. A task hands on at most that number of rows per view and label.
    """

    def ask(fitted: list[Logistic], given: list[np.ndarray], most: tuple[int, int]) -> list[Offer]:
        held = pool.sparkSession.sparkContext.broadcast((fitted, given))  # bounded by the numbers asked for

        def run(batches):
            fitted, given = held.value
            best: dict[tuple[int, int], tuple] = {}
            for batch in batches:
                uid, rows = np.asarray(batch.column(0)), _read(batch.column(1))
                for k, x in enumerate(unpack(rows)):
                    p, old = fitted[k].proba(x), np.isin(uid, given[k])
                    for label in (0, 1):
                        sure = p if label else 1 - p
                        at = np.flatnonzero((sure >= SURE) & ~old)
                        before = best.get((k, label), (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, PACKED)))
                        merged = [np.concatenate(c) for c in zip(before, (sure[at], uid[at], rows[at]), strict=True)]
                        order = np.lexsort((merged[1], -merged[0]))[: most[label]]
                        best[k, label] = tuple(c[order] for c in merged)
            for (k, label), (sure, uid, rows) in best.items():
                n = len(uid)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, label), pa.int32()), pa.array(sure), pa.array(uid), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["view", "label", "sure", "uid", "x"],
                )

        found = materialize(pool.select("uid", "x").mapInArrow(run, "view int, label int, sure double, uid long, x binary"))
        offers = []
        for k in (0, 1):
            parts = [found.where((F.col("view") == k) & (F.col("label") == label)).orderBy(F.desc("sure"), "uid").limit(most[label]).select("uid", "x").toArrow() for label in (0, 1)]
            uid = np.concatenate([np.asarray(t["uid"]) for t in parts])
            offers.append((uid, np.repeat([0, 1], [t.num_rows for t in parts]), np.concatenate([_read(t["x"]) for t in parts])))
        return offers

    return ask


def co_train(rows: np.ndarray, y: np.ndarray, ask: Callable[[list[Logistic], list[np.ndarray], tuple[int, int]], list[Offer]], rounds: int = ROUNDS) -> Model:
    """Fit on three quarters of the labelled rows of each label; the rest calibrates the views and combines them.

    Without rows of both labels the model is their share, 1 where nothing is labelled. With fewer than four rows of a label
    the views are calibrated on the rows that they are fitted on.
    """
    model = Model(float(y.mean()) if len(y) else 1.0)
    if len(np.unique(y)) < 2:
        return model
    views = unpack(rows)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[3::4]] = True
    shown = held if len(np.unique(y[held])) == 2 else np.ones(len(y), bool)
    learned = [(np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, PACKED))] * 2  # by each view, from the other
    fitted = [Logistic().fit(v[~held], y[~held].astype(float)) for v in views]
    most = tuple(max(1, int(GIVEN * (y == label).sum())) for label in (0, 1))
    for _ in range(rounds):
        offers = ask(fitted, [learned[1 - k][0] for k in (0, 1)], most)
        for k in (0, 1):
            learned[k] = tuple(np.concatenate(c) for c in zip(learned[k], offers[1 - k], strict=True))
            x = np.vstack([views[k][~held], unpack(learned[k][2])[k]])
            fitted[k] = Logistic().fit(x, np.concatenate([y[~held], learned[k][1]]).astype(float))
        if not any(len(o[0]) for o in offers):
            break
    calibrations = [Logistic(0.1).fit(f.logit(v[shown])[:, None], y[shown].astype(float)) for f, v in zip(fitted, views, strict=True)]
    logits = np.column_stack([c.logit(f.logit(v[shown])[:, None]) for c, f, v in zip(calibrations, fitted, views, strict=True)])
    model.views, model.calibrations, model.combined = fitted, calibrations, Logistic(0.1).fit(logits, y[shown].astype(float))
    return model


def unlabelled(packed: DataFrame, labels: DataFrame, keep_held_out: bool = False) -> DataFrame:
    """Rows of packed that may get pseudo-labels: no label names their doc_id, nor are they held out unless keep_held_out."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("known_id")).distinct()
    rest = packed.join(known, packed["doc_id"] == known["known_id"], "left_anti")
    return rest if keep_held_out else rest.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))


def fit(packed: DataFrame, labels: DataFrame, keep_held_out: bool = False) -> Model:
    """Learn from a bounded sample of labelled rows of labels (doc_id, quality) and from all rows of packed without a label."""
    labelled = with_labels(packed, labelled_rows(labels, "quality", keep_held_out, TRAIN_ROWS)).select("uid", "label", "x").toArrow().sort_by("uid")
    pool = materialize(unlabelled(packed, labels, keep_held_out))
    return co_train(_read(labelled["x"]), np.asarray(labelled["label"], int), surest(pool))


def score(packed: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) of every row of packed. Nulls are features of their own; an empty text is scored like any other."""
    held = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(*unpack(_read(batch.column(1)))))], names=["doc_id", "score"])

    return packed.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score is at least the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def decide(whole):
        return np.concatenate([np.zeros(0), *(held.value.score(*unpack(pack(batch))) for batch in slices(whole, budget=SLICE))]) >= threshold

    return filter_rows(docs, input_columns(docs), decide)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that a classifier learned from docs and all of labels doesn't reject."""
    return keep(docs, fit(packed_views(docs), labels, keep_held_out=True), threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, keep for every row of docs; learned outside the held-out fold.

    docs has doc_id and text; source, lang and n_chars are read where they are. Rows that repeat, null doc_ids and very long
    texts are scored like any other, an empty table gives no rows, and equal rows get equal scores.
    """
    packed = packed_views(docs)
    scored = score(packed, fit(packed, labels))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("keep", F.col("score") >= threshold)
