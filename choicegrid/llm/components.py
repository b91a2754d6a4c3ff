"""Connected components of an edge table by large-star and small-star rounds.

Every round is two aggregations keyed by a node; a node's neighbours are never gathered in one row, only their least is.
The least comes back to the edges by a join that sends hubs, of which there are few, by a broadcast. Rounds end when no edge
changes. Each round is written to the shared folder, so its lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours go to the least node of its neighbourhood (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
    return join_hot(both.where("v > u"), least, "u", "k", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them. edges has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    met = join_hot(edges, least, "a", "k", n)
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least member) of every node of edges (a, b: long). Loops and repeated edges are fine; no edges, no rows."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        large = materialize(_large_star(edges, n))
        edges = materialize(_small_star(large, n))  # a star never has more edges than there were
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen, n = state, state["n"]
    else:
        raise RuntimeError("the components didn't settle")
    # a settled forest has one edge per node, to its component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
