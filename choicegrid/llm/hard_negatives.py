"""Hard negatives by inner product, found through a pivot table.

Rows get one more component, the root of what their squared length lacks to the largest one, and anchors a zero there; then
the Euclidean distance of an anchor and a row falls as their inner product grows. A table holds every row's distances to a
few pivots. The triangle inequality over it brackets each score, for whole tiles of rows first and for single rows then, and
only rows whose bracket meets what an anchor looks for are checked exactly.

Rows are dealt once into tiles, the cells of their nearest pivots cut to a bounded size; anchors (a stated set of queries)
meet tiles in blocks, so no group is larger than a tile and a block, whatever vectors repeat. Two passes: the first finds
each anchor's positives, and starts with the anchor's own tile, whose scores bound the others; the second finds, for the
score windows of the positives, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .pairs import spans, whole_groups

#: Pivots, and rows that they are chosen from; both bound what the driver holds.
PIVOTS, SAMPLE = 24, 2_000
#: Rows of a tile and anchors of a block, about.
TILE, BLOCK = 4_096, 512
#: Squared lengths of whole numbers below this one have exact inner products in double precision.
EXACT = 2.0**53

MEMBERS = "uid long, vec_id long, label string, x array<double>, near array<double>"


def takes_part() -> Column:
    """Whether a row has a label and a vector whose components are all finite."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """uid, vec_id, label, x of the rows that take part: x is floor(scale * component), as double. A squared length from 2^53 on fails the query."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * scale)
    x = F.transform(scaled, lambda v: F.when(F.abs(v) < 1e8, F.floor(v).cast("double")).otherwise(v))
    rows = vectors.where(takes_part()).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return rows.select("uid", "vec_id", "label", F.when(square < EXACT, F.col("x")).otherwise(F.raise_error(F.lit("a vector is too long for exact scores"))).alias("x"))


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that gives all of them the squared length `most`."""
    return np.column_stack([x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample that lie far from each other, each the farthest from those before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(far.argmax()))
    return sample[chosen]


def column(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(whole.flatten(), np.float64).reshape(len(whole), -1)


def pivot_table(rows: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """rows with near (distances of the augmented row to the pivots) and cell, the nearest pivot. Rows of other widths than the pivots' are passed over."""

    def run(batches):
        for batch in batches:
            widths = np.diff(np.asarray(batch.column(3).offsets))
            batch = batch.filter(pa.array(widths == pivots.shape[1] - 1))
            near = distances(augmented(column(batch.column(3)), most), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * len(pivots), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.argmin(axis=1) if len(near) else np.zeros(0, int), pa.int64())], names=["uid", "vec_id", "label", "x", "near", "cell"])

    return rows.select("uid", "vec_id", "label", "x").mapInArrow(run, f"{MEMBERS}, cell long")


def tiled(table: DataFrame, tile: int, name: str = "name") -> tuple[DataFrame, int]:
    """(table with the number of the tile that a row belongs to; how many there are).

    A cell has about its rows / tile tiles, which a hash deals; cells of less than half a tile share one until it is full.
    """
    counts = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per pivot
    first, number, parts, shared, room = [], [], 0, 0, 0
    for cell in range(max(counts, default=-1) + 1):
        n = counts.get(cell, 0)
        if 2 * n < tile:
            if n > room:
                shared, room, parts = parts, tile, parts + 1
            room -= n
            first.append(shared)
            number.append(1)
        else:
            first.append(parts)
            number.append(-(-n // tile))
            parts += number[-1]
    at = lambda values: F.get(F.array(*map(F.lit, values or [0])), F.col("cell").cast("int"))
    return table.withColumn(name, (at(first) + F.pmod(F.xxhash64("uid", F.lit(5)), at(number))).cast("long")), parts


def bounds(of_rows: np.ndarray, of_anchors: np.ndarray, most: float, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of each anchor with each row that the pivots allow, a little wider for rounding."""
    low, high = np.zeros((len(of_anchors), len(of_rows))), np.full((len(of_anchors), len(of_rows)), np.inf)
    for k in range(of_rows.shape[1]):
        a, r = of_anchors[:, k, None], of_rows[None, :, k]
        np.maximum(low, np.abs(a - r), out=low)
        np.minimum(high, a + r, out=high)
    slack = 1e-9 * (most + squares[:, None]) + 0.5
    return (most + squares[:, None] - high**2) / 2 - slack, (most + squares[:, None] - low**2) / 2 + slack


def tile_bounds(of_rows: np.ndarray, of_anchors: np.ndarray, most: float, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a whole tile, by the least and largest distance of its rows to each pivot."""
    low, high = of_rows.min(axis=0), of_rows.max(axis=0)
    near = np.maximum(np.maximum(low - of_anchors, of_anchors - high), 0).max(axis=1)
    far = (of_anchors + high).min(axis=1)
    slack = 1e-9 * (most + squares) + 0.5
    return (most + squares - far**2) / 2 - slack, (most + squares - near**2) / 2 + slack


def checked(rows: dict, anchors: dict, least: np.ndarray, largest: np.ndarray, most: float, step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of a tile and a block, for the pairs whose bracket meets [least, largest] of the anchor; scores are exact."""
    squares = np.einsum("ij,ij->i", anchors["x"], anchors["x"])
    low, high = tile_bounds(rows["near"], anchors["near"], most, squares)
    some = np.flatnonzero((high >= least) & (low <= largest))
    for begin in range(0, len(some), step):
        own = some[begin : begin + step]
        low, high = bounds(rows["near"], anchors["near"][own], most, squares[own])
        open_ = (high >= least[own, None]) & (low <= largest[own, None])
        left = np.flatnonzero(open_.any(axis=0))
        scores = anchors["x"][own] @ rows["x"][left].T
        a, r = np.nonzero(open_[:, left] & (scores >= least[own, None]) & (scores <= largest[own, None]))
        yield own[a], left[r], scores[a, r]


def first_of(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each key, by falling score and growing id."""
    order = np.lexsort((ids, -scores, keys))
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(order)]])))
    return order[rank < n]


def boxes(frame: DataFrame, key: str, *more: Column) -> DataFrame:
    """key, low, high: the least and largest distance to each pivot of the rows of a key."""
    n = frame.select(F.size("near")).first()[0]
    side = lambda f: F.array(*(f(F.get("near", F.lit(k))) for k in range(n)))
    return frame.groupBy(key).agg(side(F.min).alias("low"), side(F.max).alias("high"), *more)


def meetings(table: DataFrame, anchors: DataFrame, blocks: int, most: float) -> DataFrame:
    """name, i of the tiles and blocks of which some row's score may reach some anchor's least, as far as their boxes tell: one row per tile and block at most."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    ours = boxes(anchors, "i", F.min("least").alias("least"), F.max(square).alias("square")).withColumnsRenamed({"low": "from", "high": "to"})
    each = boxes(table, "name").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(ours, "i")
    apart = F.zip_with(F.zip_with("low", "to", lambda x, y: x - y), F.zip_with("from", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    reach = (most + F.col("square") - F.pow(F.array_max(apart), 2)) / 2 + 1e-9 * (most + F.col("square")) + 0.5
    return each.where(reach >= F.col("least")).select("name", "i")


def side_by_side(table: DataFrame, anchors: DataFrame, meet: DataFrame | None) -> DataFrame:
    """Rows of tiles and anchors of blocks that meet, side by side: name (tile), i (block), j = 0, and the anchor's own columns, null for a row.

    Without meet, tiles meet the anchors among their own rows.
    """
    extra = [c for c in anchors.columns if c not in ("uid", "vec_id", "label", "x", "near", "name", "i")]
    if meet is None:
        rows, asks = table.withColumn("i", F.lit(0).cast("long")), anchors.withColumn("i", F.lit(0).cast("long"))
    else:
        rows, asks = table.join(meet, "name"), anchors.drop("name").join(meet, "i")
    rows = rows.select("name", "i", "uid", "vec_id", "label", "x", "near", *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra), F.lit(False).alias("asks"))
    asks = asks.select("name", "i", "uid", "vec_id", "label", "x", "near", *extra, F.lit(True).alias("asks"))
    both = rows.unionByName(asks).withColumn("j", F.lit(0).cast("long"))
    return both.repartition("name", "i").sortWithinPartitions("name", "i")


def _parts(table: pa.Table) -> dict:
    return {"uid": np.asarray(table["uid"]), "vec_id": np.asarray(table["vec_id"]), "label": np.asarray(table["label"].to_pylist(), object), "x": column(table["x"]), "near": column(table["near"])}


def met(batches, tile: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(rows, anchors) of each tile and block; those without either are passed over."""
    for table, numbers in whole_groups(batches, 2 * tile):
        for begin, end in spans(numbers):
            group = table.slice(begin, end - begin)
            asks = np.asarray(group["asks"])
            if asks.any() and not asks.all():
                yield group.filter(pa.array(~asks)), group.filter(pa.array(asks))


def positives(table: DataFrame, anchors: DataFrame, meet: DataFrame | None, n: int, most: float, tile: int) -> DataFrame:
    """anchor, positive_id, score, place of the first n other rows of the anchor's label with a score of at least its `least`, in the tiles that it meets."""

    def run(batches):
        for rows, asks in met(batches, tile):
            r, a = _parts(rows), _parts(asks)
            found = []
            for i, j, score in checked(r, a, np.asarray(asks["least"], np.float64), np.full(len(asks), np.inf), most):
                ok = (r["label"][j] == a["label"][i]) & (r["vec_id"][j] != a["vec_id"][i])
                i, j, score = i[ok], j[ok], score[ok]
                best = first_of(i, score, r["vec_id"][j], n)
                found.append((a["uid"][i[best]], r["vec_id"][j[best]], score[best].astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["anchor", "positive_id", "score"])

    pairs = side_by_side(table, anchors, meet).mapInArrow(run, "anchor long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= n)


def negatives(table: DataFrame, anchors: DataFrame, meet: DataFrame, n: int, window: tuple[int, int], most: float, tile: int) -> DataFrame:
    """anchor, place, rank, negative_id, score: for each place of the anchor's list `tops` (scores of its positives), the first n rows of other labels in its score window.

    The windows of an anchor lie between its `least` and `largest`.
    """
    low, high = window

    def run(batches):
        for rows, asks in met(batches, tile):
            r, a = _parts(rows), _parts(asks)
            tops = asks["tops"].to_pylist()
            width = max(map(len, tops))
            top = np.array([t + [-1] * (width - len(t)) for t in tops], np.int64)  # a window of a negative score is empty
            found = []
            for i, j, score in checked(r, a, np.asarray(asks["least"], np.float64), np.asarray(asks["largest"], np.float64), most):
                ok = r["label"][j] != a["label"][i]
                i, j, score = i[ok], j[ok], score[ok].astype(np.int64)
                for k in range(width):
                    s = top[i, k]
                    held = np.flatnonzero((s >= 0) & (low * s <= 100 * score) & (100 * score <= high * s))
                    best = held[first_of(i[held], score[held], r["vec_id"][j[held]], n)]
                    found.append((a["uid"][i[best]], np.full(len(best), k + 1), r["vec_id"][j[best]], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["anchor", "place", "negative_id", "score"])

    pairs = side_by_side(table, anchors, meet).mapInArrow(run, "anchor long, place long, negative_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0, pivots: int = PIVOTS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    anchor is a condition on vec_id. An anchor's positives are the first n_positives other rows of its label by inner product
    of the whole numbers floor(scale * component); for each of them, the first n_negatives rows of other labels with
    window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score, so a positive with a negative score has
    none. Higher scores come first, ties by smaller vec_id. Rows with a null label, a null or empty vector, or a null or
    non-finite component take no part, nor do rows without a vec_id; vectors of another width than most rows of the pivots'
    sample don't either. A vec_id that repeats is one row each, and no row is a positive of an anchor with its vec_id. An
    empty table, or one without anchors, gives no rows. Other columns of vectors are passed over.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = materialize(whole_numbers(vectors.where("vec_id is not null").select("vec_id", "embedding", "label"), scale))
    width = F.size("x")
    sample = rows.orderBy(F.xxhash64("uid", F.lit(11))).limit(SAMPLE).groupBy(width.alias("w")).agg(F.collect_list("x").alias("x")).orderBy(F.desc(F.size("x")), "w").first()
    if sample is None:
        return none
    most = rows.where(width == sample["w"]).agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    chosen = choose_pivots(augmented(np.array(sample["x"]), most), pivots)
    parted, _ = tiled(materialize(pivot_table(rows, chosen, most)), tile)
    flat = np.column_stack([chosen[:, :-1], np.zeros(len(chosen))])
    lift = chosen[:, -1] ** 2

    def as_anchors(batches):
        for batch in batches:
            x = column(batch.column(3))
            # an anchor's last component is zero, a pivot's isn't
            near = np.sqrt(distances(np.column_stack([x, np.zeros(len(x))]), flat) ** 2 + lift)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * len(lift), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists, *batch.columns[4:]], names=["uid", "vec_id", "label", "x", "near", "name", "cell"])

    asking = parted.where(anchor).select("uid", "vec_id", "label", "x", "name", "cell").mapInArrow(as_anchors, f"{MEMBERS}, name long, cell long")
    own, blocks = tiled(materialize(asking), block, "i")
    if not blocks:
        return none
    own = own.drop("cell")

    unbounded = F.lit(float("-inf"))
    start = positives(parted, own.withColumn("least", unbounded), None, n_positives, most, tile)
    start = start.where(F.col("place") == n_positives).select(F.col("anchor").alias("uid"), F.col("score").cast("double").alias("bound"))
    bounded = materialize(own.join(start, "uid", "left").withColumn("least", F.coalesce("bound", unbounded)).drop("bound"))
    good = materialize(positives(parted, bounded, meetings(parted, bounded, blocks, most), n_positives, most, tile))

    tops = good.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p")).select(F.col("anchor").alias("uid"), F.col("p.score").alias("tops"))
    # a positive with a negative score has an empty window
    tops = tops.withColumn("held", F.filter("tops", lambda v: v >= 0)).where(F.size("held") > 0)
    ends = ((F.array_min("held") * window[0] / 100 - 1).alias("least"), (F.array_max("held") * window[1] / 100 + 1).alias("largest"))
    windows = materialize(own.join(tops.select("uid", "tops", *ends), "uid"))
    bad = negatives(parted, windows, meetings(parted, windows, blocks, most), n_negatives, window, most, tile)
    named = own.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = bad.withColumnRenamed("score", "negative_score").join(good.withColumnRenamed("score", "positive_score"), ["anchor", "place"]).join(named, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
