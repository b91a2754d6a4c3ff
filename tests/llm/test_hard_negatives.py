"""Hard negatives: against every pair, with tiles and blocks of a few rows; brackets hold for every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicegrid.llm import hard_negatives as hn


def brute(rows, anchor, n=5):
    kept = [(i, v, lab, np.floor(256 * np.array(e, float))) for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and len(e) == 8]
    out = []
    for i, v, lab, e in kept:
        if not anchor(v):
            continue
        scored = sorted((-int(f @ e), w, g) for j, w, g, f in kept if w != v)
        good = [(w, -s) for s, w, g in scored if g == lab][:n]
        for w, top in good:
            bad = [(u, -s) for s, u, g in scored if g != lab and 80 * top <= -100 * s <= 100 * top][:n]
            out += [(v, w, k + 1, u, top, s) for k, (u, s) in enumerate(bad)]
    return sorted(out)


def table(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8))
    x = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, 8)) * 0.3
    x[: n // 3] = x[0]  # one vector that a third of the rows have
    x[n // 3 : n // 3 + 10] = np.round(x[n // 3 : n // 3 + 10])
    rows = [(int(i), [float(np.float32(v)) for v in x[i]], int(rng.integers(3))) for i in rng.permutation(n)]
    odd = [(700, None, 1), (710, [1.0] * 8, None), (720, [1.0, None, *[0.0] * 6], 1), (730, [float("nan")] * 8, 1), (740, [float("inf")] * 8, 1), (750, [], 1), (None, [1.0] * 8, 1), (760, [0.0] * 8, 2), (770, [1.0] * 3, 1)]
    return [*rows, *odd, rows[5], rows[5], (rows[7][0], rows[8][1], 2)]


@pytest.mark.parametrize("seed, n, clusters, tile, block", [(1, 300, 5, 40, 3), (2, 200, 1, 4096, 512), (3, 240, 20, 16, 8)])
def test_every_pair(spark, seed, n, clusters, tile, block):
    rows = table(seed, n, clusters)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    found = hn.mine(frame, F.col("vec_id") % 10 == 0, pivots=6, tile=tile, block=block)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == columns
    wanted = brute(rows, lambda v: v % 10 == 0)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 100


def test_brackets():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(200, 8)) * 256)
    most = float((x * x).sum(axis=1).max())
    pivots = hn.choose_pivots(hn.augmented(x, most), 6)
    near = hn.distances(hn.augmented(x, most), pivots)
    asks = np.column_stack([x[:20] * 3, np.zeros(20)])
    flat = hn.distances(asks, pivots)
    low, high = hn.bounds(near, flat, most, (asks**2).sum(axis=1))
    scores = asks[:, :-1] @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    some_low, some_high = hn.tile_bounds(near, flat, most, (asks**2).sum(axis=1))
    assert (some_low[:, None] <= scores).all() and (scores <= some_high[:, None]).all()
    # clusters apart are left out without an exact check
    far = np.floor(np.concatenate([rng.normal(size=(50, 8)) + 40, rng.normal(size=(50, 8)) - 40]) * 256)
    most = float((far * far).sum(axis=1).max())
    pivots = hn.choose_pivots(hn.augmented(far, most), 4)
    near = hn.distances(hn.augmented(far, most), pivots)
    _, high = hn.bounds(near, hn.distances(np.column_stack([far[:50], np.zeros(50)]), pivots), most, (far[:50] ** 2).sum(axis=1))
    assert (high[:, 50:] < 0).all()


def test_edges(spark):
    kind = "vec_id long, embedding array<double>, label int"
    none = spark.createDataFrame([], kind)
    assert hn.mine(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], kind)
    assert hn.mine(one, F.col("vec_id") % 10 == 0).count() == 0
    # ties: equal scores come by id; a zero score has negatives of score zero only
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [1.0, 0.0], 2), (4, [0.0, 3.0], 3)]
    found = sorted(map(tuple, hn.mine(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()))
    assert found == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 4, 0, 0)]
    with pytest.raises(Exception, match="too long"):
        hn.mine(spark.createDataFrame([(0, [1e9, 0.0], 1)], kind), F.col("vec_id") == 0).count()
