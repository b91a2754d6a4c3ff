"""Selections and checks that a scoring protocol states: cutoffs, window sessions, option payloads, acceptance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CHOICE, SESSION


def within_cutoff(choices: DataFrame, most_tokens: int) -> DataFrame:
    """Choices whose tokens all lie before the session's cutoff. choices has first_token and num_tokens.

    A choice that the cutoff splits fails the query.
    """
    end = F.col("first_token") + F.col("num_tokens")
    split = (F.col("first_token") < most_tokens) & (end > most_tokens)
    keep = F.when(split, F.raise_error(F.lit("the cutoff splits a choice")).cast("boolean")).otherwise(end <= most_tokens)
    return choices.where(keep)


def expected_scores(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """The scores of the expected choices; a missing one, or another number of tokens, fails the query."""
    joined = expected.select(*CHOICE, F.col("num_tokens").alias("expected_tokens")).join(scores, CHOICE, "left")
    fine = F.when(F.col("nll").isNull(), F.raise_error(F.lit("an expected choice has no score")).cast("boolean")).when(
        F.col("num_tokens") != F.col("expected_tokens"), F.raise_error(F.lit("token counts differ")).cast("boolean")
    )
    return joined.where(fine.otherwise(F.lit(True))).drop("expected_tokens")


def against_published(ours: DataFrame, published: DataFrame) -> DataFrame:
    """experiment, ours, published, gap of every task that either has."""
    both = ours.select("experiment", F.col("task_nll").alias("ours")).join(published.select("experiment", F.col("task_nll").alias("published")), "experiment", "full")
    return both.withColumn("gap", F.abs(F.col("ours") - F.col("published")))


def published_gaps(ours: DataFrame, published: DataFrame) -> DataFrame:
    """One row: tasks, mean_gap, max_gap against the published values; a published task that we lack fails the query."""
    both = against_published(ours, published).where("published is not null")
    gap = F.when(F.col("ours").isNull(), F.raise_error(F.concat(F.lit("no value for "), "experiment")).cast("double")).otherwise(F.col("gap"))
    return both.agg(F.count("*").alias("tasks"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def report_gap(rows: DataFrame) -> DataFrame:
    """One row: how far the means over tasks of task means of delta lie apart. rows has delta."""
    return rows.groupBy("experiment").agg(F.avg("delta").alias("gap")).agg(F.abs(F.avg("gap")).alias("report_gap"))


def index_differences(packed: DataFrame, alone: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side (`packed` or `alone`) of rows that only one of two runs has; nothing where both scored the same rows."""
    one = packed.select(*keys).join(alone.select(*keys), keys, "left_anti").withColumn("side", F.lit("packed"))
    return one.unionByName(alone.select(*keys).join(packed.select(*keys), keys, "left_anti").withColumn("side", F.lit("alone")))


def window_grid(lengths: DataFrame, windows: list[int], targets: Column) -> DataFrame:
    """Requests of each session (experiment, participant, n_segments) under every window at its targets, and of all choices unlimited.

    Adds condition, window (null: unlimited), target_index, effective_window, target_fraction, is_anchor.
    """
    fraction = F.col("target_index") / F.greatest(F.col("n_segments") - 1, F.lit(1))
    anchors = lengths.select(*SESSION, "n_segments", F.explode(targets).alias("target_index"))
    limited = anchors.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    limited = limited.select(*SESSION, "n_segments", "window", "target_index", F.least("window", "target_index").alias("effective_window"), F.lit(True).alias("is_anchor"))
    every = lengths.select(*SESSION, "n_segments", targets.alias("targets"), F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)).alias("target_index"))
    full = every.withColumn("is_anchor", F.array_contains("targets", F.col("target_index")))
    full = full.select(*SESSION, "n_segments", F.lit(None).cast("int").alias("window"), "target_index", F.col("target_index").alias("effective_window"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    condition = F.when(F.col("window").isNull(), "full").otherwise(F.concat(F.lit("w"), F.col("window").cast("string")))
    return limited.unionByName(full).withColumn("condition", condition).withColumn("target_fraction", fraction)


def floor_statistics(rows: DataFrame) -> DataFrame:
    """One row: mean and largest gap of rows, and mean, 95th percentile and largest gap of task means. rows has delta."""
    tasks = rows.groupBy("experiment").agg(F.abs(F.avg("delta")).alias("gap"), F.sum(F.abs("delta")).alias("total"), F.max(F.abs("delta")).alias("most"), F.count("*").alias("n"))
    return tasks.agg(
        (F.sum("total") / F.sum("n")).alias("row_mae"), F.max("most").alias("row_max"), F.avg("gap").alias("task_mae"), F.percentile("gap", 0.95).alias("task_p95"), F.max("gap").alias("task_max")
    )


def window_violations(rows: DataFrame, windows: list[int]) -> DataFrame:
    """experiment, participant, rule, n: what is wrong with sessions scored under several windows.

    rows has window (null: unlimited), target_index, effective_window, n_segments, target_fraction, is_anchor.
    """
    full, limited = F.col("window").isNull(), F.col("window").isNotNull()
    effective = F.when(full, F.col("target_index")).otherwise(F.least("window", "target_index"))
    fraction = F.col("target_index") / F.greatest(F.col("n_segments") - 1, F.lit(1))
    checks = {
        "target_out_of_range": (F.col("target_index") < 0) | (F.col("target_index") >= F.col("n_segments")),
        "effective_window": F.col("effective_window") != effective,
        "target_fraction": F.abs(F.col("target_fraction") - fraction) > 1e-12,
        "unknown_window": limited & ~F.col("window").isin(*windows),
        "limited_off_anchor": limited & ~F.col("is_anchor"),
    }
    # one row per window and target first: distinct ones are counted without a copy of the rows for each count, and rows are read once
    cells = rows.groupBy(*SESSION, "window", "target_index").agg(
        F.max("n_segments").alias("segments"),
        F.min("n_segments").alias("least_segments"),
        F.coalesce(F.bool_or("is_anchor"), F.lit(False)).alias("anchor"),
        *(F.count_if(c).alias(n) for n, c in checks.items()),
    )
    known = full & F.col("target_index").isNotNull()
    sessions = cells.groupBy(*SESSION).agg(
        F.max("segments").alias("segments"),
        F.min("least_segments").alias("least_segments"),
        F.count_if(known).alias("covered"),
        F.count_if(known & F.col("anchor")).alias("anchors"),
        F.count_if(limited).alias("cells"),
        *(F.sum(n).alias(n) for n in checks),
    )
    wide = {
        "segments_differ": F.col("segments") != F.col("least_segments"),
        "segments_not_covered": F.col("covered") != F.col("segments"),
        "anchors_not_covered": F.col("cells") != F.col("anchors") * len(windows),
    }
    broken = lambda c, rule, n: F.when(c, F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n")))
    found = [*(broken(F.col(n) > 0, n, F.col(n)) for n in checks), *(broken(c, n, F.lit(1)) for n, c in wide.items())]
    return sessions.select(*SESSION, F.inline(F.array_compact(F.array(*found))))


def option_violations(options: DataFrame, predictions: DataFrame, keys: list[str] = CHOICE) -> DataFrame:
    """keys, rule: options whose payload can't be. options has option, logprob, n_tokens, is_human."""
    per = options.groupBy(*keys).agg(
        F.bool_or(F.col("n_tokens") != 1).alias("tokens"),
        F.bool_or(F.col("logprob").isNull() | F.isnan("logprob") | (F.col("logprob") > 0) | (F.col("logprob") == float("-inf"))).alias("logprob"),
        F.bool_or(F.coalesce(F.col("option"), F.lit("")) == "").alias("empty"),
        F.array_sort(F.collect_list(F.when(F.col("is_human"), F.col("option")))).alias("human"),
    )
    joined = per.join(predictions.select(*keys, "human_choice", "options_status"), keys)
    rules = {
        "not_scored": F.col("options_status") != "scored", "empty_option": F.col("empty"), "several_tokens": F.col("tokens"), "logprob": F.col("logprob"),
        "human_option": F.col("human") != F.array("human_choice"),
    }
    rule = F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules.items()))
    return joined.select(*keys, rule.alias("rule")).where("rule is not null")


def session_conditions(predictions: DataFrame, commits: DataFrame) -> DataFrame:
    """experiment, participant, rule: sessions whose receipt names other conditions than their rows have, or other counts of them."""
    found = predictions.groupBy(*SESSION, "condition").agg(F.count("*").alias("n"))
    found = found.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("condition", "n"))).alias("found"))
    stated = commits.select(*SESSION, F.array_sort(F.transform(F.map_entries("conditions"), lambda e: F.struct(e["key"].alias("condition"), e["value"].cast("long").alias("n")))).alias("stated"))
    stated = stated.withColumn("stated", F.filter("stated", lambda e: e["n"] > 0))
    joined = stated.join(found, SESSION, "full")
    none = F.array().cast("array<struct<condition:string,n:bigint>>")
    found, stated = F.coalesce("found", none), F.coalesce("stated", none)
    rule = F.when(F.transform(found, lambda e: e["condition"]) != F.transform(stated, lambda e: e["condition"]), "conditions").when(found != stated, "counts")
    return joined.select(*SESSION, rule.alias("rule")).where("rule is not null")


def shard_counts(predictions: DataFrame, expected_sessions: int) -> DataFrame:
    """One row: sessions, expected, complete: whether the output holds as many sessions as the input."""
    return predictions.agg(F.countDistinct(*SESSION).alias("sessions")).select("sessions", F.lit(expected_sessions).cast("long").alias("expected"), (F.col("sessions") == expected_sessions).alias("complete"))


def acceptance(predictions: DataFrame, sessions: DataFrame, conditions: list[str]) -> DataFrame:
    """experiment, participant, missing: conditions that a session of the input lacks in the output."""
    found = predictions.groupBy(*SESSION).agg(F.collect_set("condition").alias("found"))
    wanted = F.array(*map(F.lit, conditions))
    joined = sessions.select(*SESSION).distinct().join(found, SESSION, "left")
    missing = F.array_join(F.array_sort(F.array_except(wanted, F.coalesce("found", F.array().cast("array<string>")))), ",")
    return joined.select(*SESSION, missing.alias("missing")).where("missing <> ''")


def run_contract(manifests: list[dict]) -> dict:
    """What all manifests of a run state alike; a key on which they differ, or which one of them lacks, is an error. Manifests are one per shard."""
    if not manifests:
        raise ValueError("no manifests")
    shared = reduce(lambda a, b: a | b, manifests)
    shared = {k: v for k, v in shared.items() if k != "shard"}
    differ = sorted(k for k in shared if any(k not in m or m[k] != shared[k] for m in manifests))
    if differ:
        raise ValueError(f"manifests differ in {differ}")
    shards = sorted(m["shard"] for m in manifests)
    if shards != list(range(len(manifests))):
        raise ValueError(f"shards {shards} are there")
    return shared


def latest_step(paths: DataFrame) -> DataFrame:
    """The path with the highest number behind `checkpoint-`."""
    step = F.regexp_extract("path", r"checkpoint-(\d+)/?$", 1).try_cast("long")
    return paths.agg(F.max_by("path", step).alias("path"), F.max(step).alias("step"))


def packed_against_alone(packed: DataFrame, alone: DataFrame) -> DataFrame:
    """condition, rows, max_gap, mean_gap, nan_mismatches of the same rows scored together and one by one."""
    keys = ["condition", *CHOICE]
    both = packed.select(*keys, F.col("nll").alias("a")).join(alone.select(*keys, F.col("nll").alias("b")), keys)
    gap = F.when(~F.isnan("a") & ~F.isnan("b"), F.abs(F.col("a") - F.col("b")))
    return both.groupBy("condition").agg(F.count("*").alias("rows"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count_if(F.isnan("a") != F.isnan("b")).alias("nan_mismatches"))


def longest_first(rows: DataFrame, length: str) -> DataFrame:
    """Rows of each partition in descending length, for batches of like lengths."""
    return rows.sortWithinPartitions(F.col(length).desc())


def batch_numbers(rows: DataFrame, group: str, length: str, order: str, budget: int) -> DataFrame:
    """Adds position within the group (longest first) and how many rows of that length fit a budget of tokens."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(length).desc(), order)) - 1
    return rows.withColumn("place", place.cast("long")).withColumn("fits", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col(length))).cast("long"))
