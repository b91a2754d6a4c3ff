"""Edges of the operators: very long texts, ties, buckets of more than a block, recall at the threshold, growth of shuffled rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicegrid.llm import binary_output, bpe, embedding_dedup, fingerprints, jaccard_join, language_id, pairs, quality
from choicegrid.llm.tokens import library


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 9973} é😀" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, None)], "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    assert [rows[k].n_chars for k in (1, 2, 3, 4)] == [len(long), len(long) + 4, 5, 0]
    assert rows[2].near_next > 0.99 and rows[3].near_next < 0.2
    ids = [*library(None).encode(long, add_special_tokens=False).ids, 1]
    packed = binary_output.pack_matrices(docs.where("doc_id in (1, 3)"), sequence=2048).collect()
    found = {}
    for r in packed:
        matrix = np.frombuffer(r.input_ids, "<u2")
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            found.setdefault(doc, {})[start] = matrix[a:b].tolist()
    assert [x for _, part in sorted(found[1].items()) for x in part] == ids


def test_tied_languages(spark):
    """Languages with the same texts: the one that sorts first, in one block or in several."""
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"words of text {k % 3}", "zyx"[k % 3]) for k, i in enumerate(learned[:150])] + [(500, "words of text 1", None)], "doc_id long, text string, lang string")
    train = docs.where("lang is not null").withColumn("text", F.lit("words of text"))
    for block in (1, 2, 128):
        rows = language_id.predict(docs.where("doc_id = 500"), train, block).collect()
        assert [(r.lang_pred, round(r.score, 6)) for r in rows] == [("x", 0.333333)]


def test_ties_between_pseudo_labels(spark):
    """Many unlabelled rows of one certainty: whichever are given labels, copies get one score, however rows are dealt."""
    good, bad = "A long and even text with many ordinary words in it, as people write.", "!!! $$$ 000 ### !!!"
    rows = [(i, good if i % 2 else bad, "en", "src", len(good if i % 2 else bad)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    scores = []
    for n in (1, 7):
        found = quality.classify(docs.repartition(n), labels).collect()
        score = next(c for c in found[0].asDict() if c == "score")
        assert len({round(r[score], 9) for r in found if r.doc_id % 2}) == 1 == len({round(r[score], 9) for r in found if not r.doc_id % 2})
        scores.append({r.doc_id: round(r[score], 6) for r in found})
    assert scores[0] == scores[1] and scores[0][1] > 0.5 > scores[0][0]


def test_a_bucket_of_several_blocks(spark):
    """More near vectors than a block holds: links and components equal brute force."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(530, 8)) * 0.15, rng.normal(size=(40, 8))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    frame = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r.vec_id: r.n_links for r in embedding_dedup.deduplicate(frame).collect()}
    links = near.sum(axis=1)
    assert sum(found.values()) >= 0.999 * links.sum() and all(found[i] <= links[i] for i in found)


def test_hot_groups_are_dealt_before_they_meet(spark, monkeypatch):
    from choicegrid.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    members = spark.createDataFrame([(1, i) for i in range(400)] + [(k, k) for k in range(2, 30)] + [(k, k + 1) for k in range(2, 30)], "name long, uid long")
    dealt = pairs.blocked(members, ["name"], "uid", "count(*)", 100)
    rows = dealt.collect()
    hot = [r for r in rows if r.name == 1]
    assert len(hot) == 400 * 4 and {(r.i, r.j) for r in hot} == {(i, j) for i in range(4) for j in range(i, 4)}
    assert all(sum((r.i, r.j) == ij for r in hot) < 3 * 100 for ij in {(r.i, r.j) for r in hot})
    assert len([r for r in rows if r.name != 1]) == 56


def test_recall_of_the_jaccard_join(spark):
    """Pairs of texts with a similarity from 0.8 to 0.84: nearly all are found, and none below."""
    rng = random.Random(9)
    rows, wanted = [], set()
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for k in range(400):
        a = [f"w{k}x{rng.randint(0, 10**9)}" for _ in range(rng.randint(60, 120))]
        b = list(a)
        cut = round(len(a) * (0.19 if k % 4 else 0.3) / 2)
        b[len(b) - cut :] = [f"v{k}x{j}" for j in range(cut)]
        x, y = grams(a), grams(b)
        if len(x & y) / len(x | y) >= 0.8:
            wanted.add(k)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    found = {r.doc_id // 2 for r in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.n_links}
    assert len(wanted) > 100 and found <= wanted and len(found) >= 0.99 * len(wanted)


def test_rows_of_words_grow_with_the_text(spark, monkeypatch):
    """Twice the text of one vocabulary is cut into twice the rows, and a bucket's words are encoded once."""
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(bpe, "BUCKET_WORDS", 500)
    rng = random.Random(4)
    words = [f"{rng.choice('abcdef')}{rng.randint(0, 9999)}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(160)]
    docs = lambda n: spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "doc_id long, text string").coalesce(1)
    sizes = {n: bpe.word_blocks(docs(n), -(-bpe.distinct_words(docs(n)) // 500), True).count() for n in (80, 160)}
    assert sizes[160] < 2.4 * sizes[80]
    found = {r.doc_id: list(r.ids) for r in bpe.encode(docs(160)).collect()}
    assert all(found[i] == library(None).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_buckets_stream_in_parts(most):
    import pyarrow as pa

    rows = [(b, k, bpe.pack(chunks=pa.array([f"c{b}{k}", "x"], pa.large_string()), wholes=pa.array([f"w{k}"], pa.large_string()), mark=pa.array([1]))) for b in range(3) for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in rows]), pa.array([b for b, _, _ in rows]), pa.array([d for *_, d in rows], pa.binary())], names=["block", "bucket", "data"])
    parts = list(bpe.same_bucket([batch.slice(0, 5), batch.slice(5)], most))
    assert [(b, k) for b, blocks, _ in parts for k in blocks] == [(b, k) for b, k, _ in rows]
    assert all(len(held) == len(blocks) and len(held) <= max(1, -(-most // 3)) for _, blocks, held in parts)
