"""Checks of sharded runs: replays, orphans, completeness, commits, and the comparison of two runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest
from ..schemas import CHOICE, SESSION


def merge_predictions(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """One row per key, the first by row_idx; rows has shard and row_idx. A key in two shards, or with two contents, fails the query."""
    marked = rows.withColumn("_digest", digest(*(F.col(c) for c in payload)))
    merged = marked.groupBy(*keys).agg(
        F.count("*").alias("copies"),
        F.min("shard").alias("shard"),
        F.max("shard").alias("last_shard"),
        F.countDistinct("_digest").alias("contents"),
        F.min_by(F.struct(*payload), "row_idx").alias("row"),
    )
    clean = (
        F.when(F.col("shard") != F.col("last_shard"), F.raise_error(F.lit("a key crosses shards")).cast("boolean"))
        .when(F.col("contents") > 1, F.raise_error(F.lit("a replay differs")).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return merged.where(clean).select(*keys, "shard", "copies", "row.*")


def merge_violations(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys whose rows cross shards or differ: keys, rule."""
    marked = rows.withColumn("_digest", digest(*(F.col(c) for c in payload)))
    table = marked.groupBy(*keys).agg(F.countDistinct("shard").alias("shards"), F.countDistinct("_digest").alias("contents"))
    rule = F.when(F.col("shards") > 1, "crosses_shards").when(F.col("contents") > 1, "replay_differs")
    return table.withColumn("rule", rule).where("rule is not null").select(*keys, "rule")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys), keys, "left_anti")


def incomplete(children: DataFrame, parents: DataFrame, keys: list[str], suffix: list[str]) -> DataFrame:
    """Parents whose distinct children are fewer or more than `expected`: keys, expected, found."""
    found = children.groupBy(*keys).agg(F.countDistinct(*suffix).alias("found"))
    table = parents.select(*keys, "expected").join(found.hint("merge"), keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return table.where("expected <> found")


#: Rows of a shard, by their number, that one group of a window holds at most.
RANGE = 100_000


def parent_changes(rows: DataFrame, span: int = RANGE) -> DataFrame:
    """rows (shard, row_idx, key, ...) with new: whether the key differs from that of the row before in the shard.

    Rows fall into ranges of row numbers, so no task holds a shard; a range's first row is compared with the last key of the
    range before it, of which there is one row per range.
    """
    ranged = rows.withColumn("_range", F.floor(F.col("row_idx") / span))
    last = ranged.groupBy("shard", "_range").agg(F.max_by("key", "row_idx").alias("_last"))
    before = last.select("shard", "_range", F.lag("_last").over(Window.partitionBy("shard").orderBy("_range")).alias("_before"))
    order = Window.partitionBy("shard", "_range").orderBy("row_idx")
    led = ranged.withColumn("_lag", F.lag("key").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    joined = led.join(before, ["shard", "_range"])
    return joined.withColumn("new", F.coalesce(previous != F.col("key"), F.lit(True))).drop("_range", "_before", "_lag", "_first")


def occurrence_outcomes(children: DataFrame, parents: DataFrame, keys: list[str], suffix: list[str], span: int = RANGE) -> DataFrame:
    """shard, row_idx, key, outcome of every row: `kept`, `replay`, `incomplete` or, without a parent, `orphan`.

    A shard's rows in their order fall into occurrences: an occurrence ends where the parent changes, a suffix repeats or
    the expected rows are there. The first complete one is kept; later ones are replays, which must be equal, and earlier
    partial ones are dropped. What an occurrence holds is decided within the rows of one parent.
    """
    key = F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys))
    part = F.concat_ws("\x1f", *(F.col(k).cast("string") for k in suffix))
    payload = digest(*(F.col(c) for c in children.columns if c not in ("shard", "row_idx")))
    rows = children.select("shard", "row_idx", key.alias("key"), part.alias("part"), payload.alias("payload"))
    parents = parents.select(key.alias("key"), F.col("expected").cast("long").alias("expected"))
    # as many parents as choices: a merge, since a compressed file's bytes would have Spark send them through the driver
    known = parent_changes(rows, span).join(parents.hint("merge"), "key", "left")
    orphans = known.where("expected is null").select(F.col("shard").cast("long").alias("shard"), F.col("row_idx").cast("long").alias("row_idx"), "key", F.lit("orphan").alias("outcome"))

    def outcomes(batches):
        name, expected, done, seen, held, waiting = None, None, None, set(), [], []
        out: list[tuple] = []

        def close():
            nonlocal done
            if held:
                whole = len(held) == expected
                if done is not None and whole and held != done:
                    raise ValueError(f"a complete replay of {name!r} differs")
                said = "replay" if done is not None else "kept" if whole else "incomplete"
                out.extend((*row, name, said) for row in waiting)
                done = list(held) if done is None and whole else done
            seen.clear()
            held.clear()
            waiting.clear()

        def handed():
            columns = zip(*out, strict=True) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "row_idx", "key", "outcome"])
            out.clear()
            return batch

        for batch in batches:
            for shard, row_idx, row_key, suffix_value, content, new, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_key != name:
                    close()
                    name, expected, done = row_key, wanted, None
                if new or suffix_value in seen:
                    close()
                seen.add(suffix_value)
                held.append(content)
                waiting.append((shard, row_idx))
                if len(held) == expected:
                    close()
            yield handed()
        close()
        yield handed()

    # a parent's rows come one after the other, in their order, so a task keeps one occurrence
    sorted_rows = known.where("expected is not null").repartition("key").sortWithinPartitions("key", "shard", "row_idx")
    columns = [F.col("shard").cast("long"), F.col("row_idx").cast("long"), "key", "part", "payload", "new", "expected"]
    decided = sorted_rows.select(*columns).mapInArrow(outcomes, "shard long, row_idx long, key string, outcome string")
    return decided.unionByName(orphans)


def merge_occurrences(children: DataFrame, parents: DataFrame, keys: list[str], suffix: list[str]) -> DataFrame:
    """key, outcome, n of the rows of every parent, by the outcomes of occurrence_outcomes."""
    return occurrence_outcomes(children, parents, keys, suffix).groupBy("key", "outcome").agg(F.count("*").alias("n"))


def commit_violations(commits: DataFrame, predictions: DataFrame) -> DataFrame:
    """experiment, participant, rule: receipts that don't add up, are named wrongly, repeat or don't agree with the predictions.

    commits may have file, the name of a receipt's file, which must be the digest of its session and `.json`.
    """
    named = F.col("file") != F.concat("digest", F.lit(".json")) if "file" in commits.columns else F.lit(False)
    again = commits.groupBy(*SESSION).agg(F.count("*").alias("n")).where("n > 1").select(*SESSION, F.lit("repeated").alias("rule"))
    counts = commits.withColumn("total", F.aggregate(F.map_values("conditions"), F.lit(0).cast("long"), lambda s, x: s + x))
    found = predictions.groupBy(*SESSION).agg(F.count("*").alias("found"))
    joined = counts.join(found, SESSION, "full")
    rule = (
        F.when(F.col("status").isNull(), "no_commit").when(F.col("found").isNull(), "no_rows")
        .when(F.col("status") != "complete", "status").when(F.col("schema") != 1, "schema").when(named, "file_name").when(F.col("total") != F.col("prediction_rows"), "sum").when(F.col("found") != F.col("prediction_rows"), "count")
    )
    return joined.withColumn("rule", rule).where("rule is not null").select(*SESSION, "rule").unionByName(again)


def matched(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows that both runs have, keyed by the key columns that both have: nll and num_tokens of each, and delta."""
    keys = [c for c in ("condition", *CHOICE) if c in reference.columns and c in candidate.columns]
    side = lambda f, s: f.select(*(F.col(k).cast("string").alias(k) if k != "choice_index" else F.col(k) for k in keys), F.col("nll").alias(f"nll_{s}"), F.col("num_tokens").alias(f"num_tokens_{s}"))
    return side(reference, "ref").join(side(candidate, "cand"), keys).withColumn("delta", F.col("nll_cand") - F.col("nll_ref"))


def key_sets(reference: DataFrame, candidate: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """keys and side: `both`, `reference` or `candidate`, for every key that either run has."""
    sides = [f.select(*(F.col(k).cast("string").alias(k) for k in keys)).distinct().withColumn(s, F.lit(True)) for f, s in ((reference, "_ref"), (candidate, "_cand"))]
    side = F.when(F.col("_ref").isNull(), "candidate").when(F.col("_cand").isNull(), "reference").otherwise("both")
    return sides[0].join(sides[1], keys, "full").select(*keys, side.alias("side"))


def worst_row(rows: DataFrame, keys: list[str] = CHOICE) -> DataFrame:
    """The matched row whose delta is largest, with its keys; the least keys on ties."""
    return rows.orderBy(F.abs("delta").desc(), *keys).limit(1).select(*keys, F.abs("delta").alias("max_delta"))


def compare_rows(rows: DataFrame) -> DataFrame:
    """One row: how far matched rows lie apart; correlation is null where a side is constant."""
    varies = (F.stddev_samp("nll_ref") > 0) & (F.stddev_samp("nll_cand") > 0)
    return rows.agg(
        F.count("*").alias("matched_rows"),
        F.max(F.abs("delta")).alias("max_delta"),
        F.avg(F.abs("delta")).alias("mean_delta"),
        F.avg("delta").alias("signed_mean"),
        varies.alias("varies"),
        F.count_if(F.col("num_tokens_ref") != F.col("num_tokens_cand")).alias("token_mismatches"),
        ((F.avg(F.col("nll_ref") * F.col("nll_cand")) - F.avg("nll_ref") * F.avg("nll_cand"))).alias("cov"),
        (F.stddev_pop("nll_ref") * F.stddev_pop("nll_cand")).alias("spread"),
    ).select("matched_rows", "max_delta", "mean_delta", "signed_mean", F.when(F.col("varies"), F.col("cov") / F.nullif("spread", F.lit(0.0))).alias("correlation"), "token_mismatches")


def grouped_delta(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row: the largest and mean gap of group means, the group of the largest, and groups."""
    means = rows.groupBy(*by).agg(F.abs(F.avg("nll_cand") - F.avg("nll_ref")).alias("gap"))
    return means.agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.count("*").alias("groups"), F.max_by(F.concat_ws("|", *by), "gap").alias("worst"))


def verdict(summary: dict, experiment_max: float, tolerance: float, row_tolerance: float, min_correlation: float, strict: bool = False, unmatched: int = 0) -> list[str]:
    """Why two runs don't agree; empty if they do. summary is the row of compare_rows."""
    if not summary["matched_rows"]:
        return ["no rows match"]
    faults = {
        "token counts differ": summary["token_mismatches"] > 0,
        "a task's mean is off": experiment_max > tolerance,
        "a row is off": summary["max_delta"] > row_tolerance,
        "correlation is low": summary["correlation"] is not None and summary["correlation"] < min_correlation,
        "sessions are missing": strict and unmatched > 0,
    }
    return [name for name, found in faults.items() if found]
