"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A table of the hash rotates the unit vectors by three rounds of random signs and a Walsh-Hadamard transform, HASHES times, and
takes the nearest signed axis of each rotation as one part of the bucket's name. A vector goes to its own bucket; besides,
the names of its next nearest axes are probed. Vectors with equal components and label are one vector to the search.

Candidates are vectors of one label that share a bucket. Each bucket's members are dealt into blocks of bounded size and
every pair of blocks is one group of its own, so no task holds a whole large bucket; small groups are read many at once. A
pair that shares several buckets is counted in the first of them only, which both vectors' lists of names tell. Cosines are
computed in double precision and groups return counts and a spanning forest of links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .components import components
from .pairs import blocked, close_pairs, dealt_groups, spanning, spans, whole_groups

TABLES = 8
HASHES = 3
#: Names per vector and table: its own and the likeliest others.
PROBES = 8
#: Members of a block of a bucket, about; blocks of larger buckets meet pairwise.
BLOCK = 512
#: Larger groups are multiplied as matrices.
SMALL_GROUP = 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=-1)
        h *= 2
        x = x.reshape(-1, n)
    return x / np.sqrt(n)


def names(unit: np.ndarray, tables: int, probes: int, seed: int = 7) -> np.ndarray:
    """Bucket names (rows x tables x probes) of unit vectors; the first of each table is the vector's own."""
    width = 1 << max(1, int(unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    out = np.zeros((len(unit), tables, probes), np.int64)
    best = min(3, 2 * width)
    for t in range(tables):
        parts = []
        for _ in range(HASHES):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            signed = np.concatenate([x, -x], axis=1)
            top = np.argpartition(-signed, best - 1, axis=1)[:, :best]
            values = np.take_along_axis(signed, top, 1)
            order = np.argsort(-values, axis=1, kind="stable")
            top, values = np.take_along_axis(top, order, 1), np.take_along_axis(values, order, 1)
            parts.append((top, values[:, :1] - values))  # what it costs to take another axis
        cost, name = parts[0][1] ** 2, parts[0][0].astype(np.int64)
        for top, lost in parts[1:]:
            cost = (cost[:, :, None] + lost[:, None, :] ** 2).reshape(len(unit), -1)
            name = (name[:, :, None] * (2 * width) + top[:, None, :]).reshape(len(unit), -1)
        found = np.take_along_axis(name, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out % (1 << 56) + (np.arange(tables, dtype=np.int64) << 56)[None, :, None]


def links() -> Column:
    """Whether a row may link: it has a label, and a vector of finite numbers with a length above zero."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def same_vector() -> Column:
    """A name that rows share when their labels and components are equal."""
    return F.sha2(F.to_json(F.struct("label", "embedding")), 256)


def near_links(unit: DataFrame, threshold: float, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """uid, degree, node, other: per group and vector, how many other vectors' copies link to it, and a link of a spanning forest.

    unit has uid (a number of its own), node, label, copies, embedding: distinct vectors.
    """

    def hashed(batches):
        for batch in batches:
            # vectors of other lengths than the batch's first are hashed apart
            vectors = batch.column(4).to_pylist()
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_width.setdefault(len(v), []).append(i)
            for rows in by_width.values():
                x = np.array([vectors[i] for i in rows], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = names(x, tables, probes)
                at = pa.array(rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, tables * probes), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(4)), pa.array([r.tobytes() for r in x], pa.binary()), flat],
                    names=["uid", "node", "label", "copies", "x", "names"],
                )

    hashes = materialize(unit.select("uid", "node", "label", "copies", "embedding").mapInArrow(hashed, "uid long, node long, label string, copies long, x binary, names array<long>"))
    buckets = hashes.select("uid", "label", F.explode(F.array_distinct("names")).alias("raw")).select("uid", "raw", F.xxhash64("label", "raw").alias("name"))
    dealt = blocked(buckets, ["name"], "uid", "count(*)", block).join(hashes, "uid")

    def link(batches):
        for table, groups in whole_groups(batches):
            widths = np.asarray(pc.binary_length(table["x"]))
            for width in np.unique(widths):  # vectors of other lengths don't link
                rows = np.flatnonzero(widths == width)
                yield _links_of(table.take(pa.array(rows)), groups[rows], threshold, tables, probes)

    columns = ["name", "raw", "i", "j", "own", "uid", "node", "label", "copies", "x", "names"]
    return dealt_groups(dealt.select(*columns)).mapInArrow(link, "uid long, degree long, node long, other long")


def _links_of(table: pa.Table, groups: np.ndarray, threshold: float, tables: int, probes: int) -> pa.RecordBatch:
    """uid, degree, node, other of the links that belong to the groups of table; its vectors have one length."""
    copies, own, apart = np.asarray(table["copies"]), np.asarray(table["own"]), np.asarray(table["i"]) != np.asarray(table["j"])
    label = np.asarray(pc.dictionary_encode(table["label"].combine_chunks()).indices)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(len(own), -1)
    lists = np.asarray(table["names"].combine_chunks().flatten()).reshape(len(own), tables, probes)
    degree, p_all, q_all = np.zeros(len(own), np.int64), [], []

    def count(p: np.ndarray, q: np.ndarray) -> None:
        ok = (label[p] == label[q]) & (~apart[p] | (own[p] != own[q]))
        p, q = p[ok], q[ok]
        for begin in range(0, len(p), 8_000):
            a, b = p[begin : begin + 8_000], q[begin : begin + 8_000]
            # the pair belongs to the bucket of the least name that both have; a table's names are in that table's lists alone
            both = (lists[a][:, :, :, None] == lists[b][:, :, None, :]).any(axis=3)
            least = np.where(both, lists[a], np.iinfo(np.int64).max).min(axis=(1, 2))
            ok = least == raw[a]
            p_all.append(a[ok])
            q_all.append(b[ok])

    raw = np.asarray(table["raw"])
    sizes = np.bincount(groups - groups[0])[groups - groups[0]] if len(groups) else groups
    small = np.flatnonzero(sizes <= SMALL_GROUP)
    for p, q in close_pairs(groups[small]):
        p, q = small[p], small[q]
        linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        count(p[linked], q[linked])
    for begin, end in spans(groups):
        if end - begin > SMALL_GROUP:
            p, q = np.nonzero(np.triu(x[begin:end] @ x[begin:end].T >= threshold, 1))
            count(p + begin, q + begin)
    p, q = (np.concatenate(v) if v else np.zeros(0, int) for v in (p_all, q_all))
    np.add.at(degree, p, copies[q])
    np.add.at(degree, q, copies[p])
    some = np.flatnonzero(degree)
    reached = spanning(len(own), [(p, q)] if len(p) else [])
    return pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (np.asarray(table["uid"]), degree)] + [table["node"].combine_chunks().take(pa.array(v)) for v in (some, reached[some])], names=["uid", "degree", "node", "other"])


def deduplicate(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows link when their labels (of any type that casts to a string) are equal and not null and their cosine is at least the threshold. A vector that is null,
    empty, zero or holds null or non-finite numbers links with nothing, nor do vectors of different lengths. Rows with the
    same vector and label are linked; a vec_id that repeats is one row each, with the same component. Ties in the component
    go to the smallest vec_id. A null vec_id
    counts among the links of others; rows with the same vector share the component of their ids, without ids it is null.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ready = rows.where(links()).withColumn("key", same_vector())
    unit = ready.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    unit = materialize(unit.withColumn("uid", F.monotonically_increasing_id()))
    found = materialize(near_links(unit, threshold, tables, probes))
    degree = found.groupBy("uid").agg(F.sum("degree").alias("degree"))
    member = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = unit.select("key", "uid", "node", "copies").join(degree, "uid", "left").join(member, "node", "left")
    classes = classes.select("key", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"), "copies")
    linked = join_hot(ready.select("vec_id", "key"), classes, "key", "copies", ready.count()).drop("key")
    alone = rows.where(~links()).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
