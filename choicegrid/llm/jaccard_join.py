"""Similarity join of documents on the Jaccard similarity of their word 5-grams.

1. Texts with the same words in the same order are one text to the join: one row each stays, with the number of copies.
2. MinHash values of each text's n-grams are cut into bands; the number of bands and rows is chosen for a target recall at
   the threshold. Texts are dealt by band hashes, and a pair belongs to the first band that its texts share. Within a
   bucket, the values' low bytes estimate the similarity of the pairs that belong to it; texts without a pair that may reach
   the threshold leave the bucket. Buckets return their members, never pairs, and large ones are dealt into blocks that
   meet pairwise.
3. The n-gram hashes of these texts, computed once, go to the buckets, and every pair that belongs to a bucket is verified
   on the full sets there. A task returns the number of links of each text and links that span them; connected components
   of those are the classes. Nothing is closed transitively before pairs are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct, join_hot, materialize
from .components import components
from .pairs import blocked, close_pairs, dealt_groups, spanning, spans, whole_groups
from .tokens import ragged, slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
SLICE = 4_000_000
#: Members and words of a block of a bucket, about.
BLOCK_ROWS, BLOCK_WORDS = 2048, 250_000
#: A pair is verified if its estimate isn't this far below the threshold (over four standard errors).
MARGIN = 0.2
_ODD = np.random.default_rng(11).integers(1, 1 << 62, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_and_rows(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows per band: the most rows whose bands reach the recall at the threshold with `most` values in all."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams of lower-case words of all texts, where each text's begin with the end, words per text).

    Words are what white space separates. A text of fewer words has one n-gram of them all; one without words, the empty one.
    """
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    parts = pc.utf8_split_whitespace(low)
    flat, ends = parts.flatten(), np.asarray(parts.offsets, np.int64)
    ends = ends - ends[0]
    coded = pc.dictionary_encode(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = np.asarray(coded.indices, np.int64)
    real = np.asarray(pc.not_equal(coded.dictionary, ""), bool)[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    ends, codes = before[ends], codes[real]
    counts = np.diff(ends)
    each = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    padded = np.concatenate([each, np.zeros(words, np.uint64)])
    docs = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(each)) - ends[:-1][docs]
    value = np.zeros(len(each), np.uint64)
    for k in range(words):  # words beyond the text count as none
        value += np.where(place + k < counts[docs], padded[k : k + len(each)], 0).astype(np.uint64) * _ODD[k]
    first = (place == 0) | (place + words <= counts[docs])
    value, docs = mixed(value[first]), docs[first]
    empty = np.flatnonzero(counts == 0)
    if len(empty):
        value, docs = np.concatenate([value, np.full(len(empty), 1, np.uint64)]), np.concatenate([docs, empty])
        order = np.argsort(docs, kind="stable")
        value, docs = value[order], docs[order]
    return value, np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(counts)))]), counts


def text_key(text: str | None) -> bytes:
    """The same for texts of the same lower-case words."""
    return xxhash.xxh3_128_digest(" ".join((text or "").lower().split()))


def minhashes(values: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (texts x n) of n-gram hashes."""
    out = np.zeros((len(begins) - 1, n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((values * _ODD[8 + k]) ^ ((values * _ODD[8 + k]) >> np.uint64(32)), begins[:-1])
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key, words, bands, low: what the join needs of each row of docs (doc_id, text); key names the text's words."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                texts = batch.column(1)
                values, begins, counts = ngram_hashes(texts)
                least = minhashes(values, begins, bands * rows)
                names = np.zeros((len(least), bands), np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        names[:, b] = mixed(names[:, b] * np.uint64(31) + least[:, b * rows + r] + np.uint64(b + 1))
                low = (least & np.uint64(255)).astype(np.uint8)
                keys = [text_key(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(keys, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, names.size + 1, bands), pa.int32()), pa.array(names.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    names=["doc_id", "key", "words", "bands", "low"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, words long, bands array<long>, low binary")


def _bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of one length as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _first_shared(a: np.ndarray, b: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether the first band that two rows of band names share is called name."""
    same = a == b
    at = np.arange(len(same)), same.argmax(axis=1)
    return same[at] & (b[at] == name)


def bucket_members(texts: DataFrame, threshold: float) -> DataFrame:
    """name, i, j, own, key: the members of each bucket, by pairs of its blocks, that a pair belonging to it may link by estimate."""
    buckets = texts.select("key", "words", F.explode("bands").alias("name"))
    blocks = f"greatest(count(*) / {BLOCK_ROWS}, sum(words) / {BLOCK_WORDS})"
    dealt = blocked(buckets, ["name"], "key", blocks, 1).join(texts.select("key", "low", "bands"), "key")

    def find(batches):
        for table, groups in whole_groups(batches):
            low, bands = _bytes(table["low"], np.uint8), np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(groups), -1)
            name, own = np.asarray(table["name"]), np.asarray(table["own"])
            apart = np.asarray(table["i"]) != np.asarray(table["j"])
            # of bytes that differ by chance one in 256 agrees
            enough = np.ceil(low.shape[1] * ((threshold - MARGIN) * 255 + 1) / 256)
            needed = np.zeros(len(groups), bool)
            for p, q in close_pairs(groups):
                ok = (low[p] == low[q]).sum(axis=1) >= enough
                p, q = p[ok], q[ok]
                ok = _first_shared(bands[p], bands[q], name[p]) & (~apart[p] | (own[p] != own[q]))
                needed[p[ok]] = needed[q[ok]] = True
            yield pa.RecordBatch.from_arrays([table[c].combine_chunks().filter(pa.array(needed)) for c in ("name", "i", "j", "own", "key")], names=["name", "i", "j", "own", "key"])

    return dealt_groups(dealt.select("name", "i", "j", "own", "key", "low", "bands")).mapInArrow(find, "name long, i int, j int, own int, key binary")


def ngram_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """key, grams: the sorted distinct n-gram hashes, packed as 64-bit numbers, of the texts of docs that wanted (node, key) names.

    Rows whose text isn't the one that key names (other texts of the same doc_id) are passed over, repeated ones count once.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                keys = batch.column(0).to_pylist()
                mine = [text_key(t) == k for k, t in zip(keys, batch.column(1).to_pylist(), strict=True)]
                batch = batch.filter(pa.array(mine, pa.bool_()))
                values, begins, _ = ngram_hashes(batch.column(1), words)
                sets = [distinct(values[a:b]).tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["key", "grams"])

    found = docs.join(wanted, docs["doc_id"] == wanted["node"]).select("key", "text")
    return found.mapInArrow(run, "key binary, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))


def _linked_pairs(sets: list[np.ndarray], belongs, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places p < q of the sets whose Jaccard similarity is at least the threshold, of pairs that belong here.

    belongs(k) gives the places after k that make such a pair with k.
    """
    sizes, p, q = np.array([len(x) for x in sets]), [], []
    large = len(sets) > 8
    if large:
        begins = np.concatenate([[0], np.cumsum(sizes)])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(int(codes.max()) + 1, np.int32)
    for k in range(len(sets) - 1):
        least = threshold * np.maximum(sizes[k], sizes) * (1 - 1e-12)
        others = belongs(k)
        others = others[np.minimum(sizes[k], sizes)[others] >= least[others]]
        if not len(others):
            continue
        if large:
            flag[codes[begins[k] : begins[k + 1]]] = 1
            at = np.concatenate([[0], np.cumsum(sizes[others])])
            both = np.add.reduceat(flag[codes[ragged(begins[others], sizes[others])]], at[:-1])
            flag[codes[begins[k] : begins[k + 1]]] = 0
        else:
            both = np.array([len(np.intersect1d(sets[k], sets[o], assume_unique=True)) for o in others.tolist()])
        others = others[both >= threshold * (sizes[others] + sizes[k] - both) * (1 - 1e-12)]
        p.append(np.full(len(others), k))
        q.append(others)
    return (np.concatenate(p), np.concatenate(q)) if p else (np.zeros(0, int), np.zeros(0, int))


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """key, degree, node, other: from rows name, i, j, own, key, node, copies, bands, grams; each pair is verified in the bucket it belongs to.

    degree counts the copies of the other text of each link; other is a node that all linked nodes of the bucket share.
    """

    def link(batches):
        for table, groups in whole_groups(batches, 2048):
            bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(groups), -1)
            name, own, node, copies, i, j = (np.asarray(table[c]) for c in ("name", "own", "node", "copies", "i", "j"))
            grams = table["grams"].combine_chunks()
            degree, other = np.zeros(len(groups), np.int64), node.copy()
            for begin, end in spans(groups):

                def belongs(k, begin=begin, end=end):
                    k += begin
                    ok = _first_shared(bands[k][None, :], bands[k + 1 : end], name[k])
                    if i[k] != j[k]:
                        ok &= own[k + 1 : end] != own[k]
                    return k + 1 - begin + np.flatnonzero(ok)

                p, q = _linked_pairs([np.frombuffer(x.as_buffer(), np.uint64) for x in grams[begin:end]], belongs, threshold)
                np.add.at(degree, p + begin, copies[q + begin])
                np.add.at(degree, q + begin, copies[p + begin])
                if len(p):
                    other[begin:end] = node[begin:end][spanning(end - begin, [(p, q)])]
            some = degree > 0
            yield pa.RecordBatch.from_arrays([table["key"].combine_chunks().filter(pa.array(some)), *(pa.array(v[some]) for v in (degree, node, other))], names=["key", "degree", "node", "other"])

    return dealt_groups(members).mapInArrow(link, "key binary, degree long, node long, other long")


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row of docs (doc_id, text).

    Two rows are linked when the Jaccard similarity of their sets of word 5-grams is at least the threshold; class_id is the
    least doc_id that links reach, and n_links counts the other rows linked directly. A null text counts as empty; texts
    without words are copies of each other. Rows that repeat are rows of their own; all texts of a doc_id are
    of one class. A null doc_id is linked with nothing.
    """
    docs = docs.select("doc_id", "text")
    bands, rows = bands_and_rows(threshold, recall)
    signed = materialize(signatures(docs, bands, rows))
    known = signed.where(F.col("doc_id").isNotNull())
    texts = known.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("words").alias("words"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    texts = materialize(texts)
    members = materialize(bucket_members(texts, threshold))
    wanted = members.select("key").distinct().join(texts.select("key", "node"), "key")
    grams = materialize(ngram_sets(docs, wanted).join(texts.select("key", "node", "copies", "bands"), "key"))
    found = materialize(verified_links(members.join(grams, "key").select("name", "i", "j", "own", "key", "node", "copies", "bands", "grams"), threshold))
    degree = found.groupBy("key").agg(F.sum("degree").alias("degree"))
    member = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = texts.select("key", "node", "copies").join(degree, "key", "left").join(member, "node", "left")
    classes = classes.select("key", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class_id"), "copies")
    out = join_hot(known.select("doc_id", "key"), classes, "key", "copies", known.count())
    alone = signed.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class of docs, that of the least doc_id, with all its columns.

    Of rows that share this doc_id the one with the least text stays. Rows with a null doc_id all stay.
    """
    chosen = similar(docs, threshold, recall).where("doc_id = class_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    known = docs.join(chosen, docs["doc_id"] == chosen["__kept_id"], "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return known.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place").unionByName(docs.where(F.col("doc_id").isNull()))
