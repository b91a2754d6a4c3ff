"""Exact quantiles of groups of any size by selection: no task holds a group, or more than a bounded part of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .joins import join_keyed

#: Bins of a round, and distinct values of a group that are looked through at once.
BINS, MOST = 64, 4_096


def exact_quantile(frame: DataFrame, by: list[str], value: str, q: float, bins: int = BINS, most: int = MOST) -> DataFrame:
    """by, quantile, n of every group with a value: the q-quantile of its n values, between two neighbours by their distance.

    Nulls and NaN are no values, and a null in `by` makes no group. Equal values are counted before anything else, so ties cost nothing. In each round a sketch
    cuts what is left of a group into about `bins` parts, exact counts tell in which parts the ranks on both sides of
    q * (n - 1) lie, and the rest is dropped; from `most` distinct values down the two neighbours are read off. Rounds grow with
    the logarithm of the largest group's distinct values.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    v = F.col(value).cast("double")
    counted = frame.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg(F.count("*").alias("k"))
    left = written(counted)
    rank = F.lit(float(q)) * (F.col("n") - 1)
    groups = left.groupBy(*by).agg(F.sum("k").alias("n"), F.count("*").alias("rows")).select(*by, "n", "rows", F.floor(rank).alias("lo"), F.ceil(rank).alias("hi"), F.lit(0).cast("long").alias("under"))
    groups, done = written(groups), None
    while True:
        small = groups.where(F.col("rows") <= most)
        found = _read_off(join_keyed(left, small, by, "rows"), by, q)
        done = found if done is None else done.unionByName(found)
        groups = groups.where(F.col("rows") > most)
        if groups.isEmpty():
            break
        inside = written(join_keyed(left, groups.select(*by, "rows"), by, "rows"))
        cuts = inside.groupBy(*by).agg(F.approx_percentile("v", [i / bins for i in range(1, bins)], 20 * bins).alias("cuts"), F.count("*").alias("rows"))
        placed = join_keyed(inside, cuts, by, "rows").select(*by, "v", "k", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin"))
        histogram = placed.groupBy(*by, "bin").agg(F.sum("k").alias("k"), F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("k").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
        bins_at = histogram.withColumn("before", before).join(groups.drop("rows"), by)
        held = bins_at.where((F.col("under") + F.col("before") <= F.col("hi")) & (F.col("under") + F.col("before") + F.col("k") > F.col("lo")))
        kept = written(held.groupBy(*by, "n", "lo", "hi").agg((F.min(F.col("under") + F.col("before"))).alias("under"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")))
        sizes = inside.groupBy(*by).agg(F.count("*").alias("all"))
        left = written(join_keyed(inside, kept.select(*by, "low", "high").join(sizes, by), by, "all").where("v between low and high").select(*by, "v", "k"))
        groups = kept.drop("low", "high")
    return done


def _read_off(rows: DataFrame, by: list[str], q: float) -> DataFrame:
    """The quantile of groups that few distinct values are left of; under counts the values below these."""
    each = rows.groupBy(*by, "n", "lo", "hi", "under").agg(F.array_sort(F.collect_list(F.struct("v", "k"))).alias("x"))
    none = F.lit(None).cast("double")
    start = F.struct(F.col("under").alias("at"), none.alias("a"), none.alias("b"))

    def step(s, x):
        end = s["at"] + x["k"]
        at = lambda rank, old: F.when(old.isNull() & (F.col(rank) < end), x["v"]).otherwise(old)
        return F.struct(end.alias("at"), at("lo", s["a"]).alias("a"), at("hi", s["b"]).alias("b"))

    both = each.withColumn("s", F.aggregate("x", start, step))
    part = F.lit(float(q)) * (F.col("n") - 1) - F.col("lo")
    return both.select(*by, (F.col("s.a") * (1 - part) + F.col("s.b") * part).alias("quantile"), "n")
