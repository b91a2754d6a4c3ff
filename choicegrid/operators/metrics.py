"""Likelihood metrics: choice to participant to experiment, with every participant of equal weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CHOICE


def per_participant(frame: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value per group and participant, and its number of rows."""
    return frame.groupBy(*by, "participant").agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("rows"))


def macro(frame: DataFrame, values: Sequence[str], by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Mean over participants of their means; adds n_participants and n_choices. Null values are skipped."""
    inner = per_participant(frame, by, values)
    return inner.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_participants"), F.sum("rows").alias("n_choices"))


def task_table(frame: DataFrame, value: str = "nll", by: Sequence[str] = ("experiment",)) -> DataFrame:
    """n_participants, n_choices, task_nll and task_probability (its geometric mean) per group."""
    table = macro(frame, [value], by).withColumnRenamed(value, "task_nll")
    return table.withColumn("task_probability", F.exp(-F.col("task_nll")))


def probability_ratio(model: DataFrame, baseline: DataFrame, value: str = "nll", baseline_value: str | None = None) -> DataFrame:
    """experiment, ratio: how much likelier the model finds a choice than the baseline does. A task that the baseline lacks fails the query."""
    ours = macro(model, [value]).select("experiment", F.col(value).alias("ours"))
    theirs = macro(baseline, [baseline_value or value]).select("experiment", F.col(baseline_value or value).alias("theirs"))
    known = F.when(F.col("theirs").isNull(), F.raise_error(F.concat(F.lit("no baseline for "), "experiment")).cast("double")).otherwise(F.col("theirs"))
    return ours.join(theirs, "experiment", "left").select("experiment", F.exp(known - F.col("ours")).alias("ratio"))


def matched_ratio(model: DataFrame, baseline: DataFrame, baseline_value: str, value: str = "nll") -> DataFrame:
    """experiment, ratio, coverage over the choices that both have; a task without any is absent. A choice that a side has twice fails the query."""
    ours = unique_by(model.select(*CHOICE, F.col(value).alias("ours")), CHOICE)
    both = ours.join(unique_by(baseline.select(*CHOICE, F.col(baseline_value).alias("theirs")), CHOICE), CHOICE)
    scored = model.groupBy("experiment").agg(F.count("*").alias("scored"))
    means = macro(both, ["ours", "theirs"])
    return means.join(scored, "experiment").select(
        "experiment", F.exp(F.col("theirs") - F.col("ours")).alias("ratio"), (F.col("n_choices") / F.col("scored")).alias("coverage")
    )


def replace_sessions(frame: DataFrame, replacement: DataFrame) -> DataFrame:
    """frame with the sessions of replacement in place of its own."""
    keys = ["experiment", "participant"]
    return frame.join(replacement.select(*keys).distinct(), keys, "left_anti").unionByName(replacement.select(*frame.columns))


def drop_excluded(frame: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return frame.where(F.coalesce(~F.col("experiment").isin(*excluded), F.lit(True))) if excluded else frame


def unique_by(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frame with a row per key; a key that repeats fails the query."""
    # value by value, since an aggregate that holds structs sorts its rows where numbers are hashed
    counted = frame.groupBy(*keys).agg(F.count("*").alias("_rows"), *(F.first(c).alias(c) for c in frame.columns if c not in keys))
    ok = F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"repeated {list(keys)}")).cast("boolean")).otherwise(F.lit(True))
    return counted.where(ok).select(*frame.columns)


def run_summary(frame: DataFrame) -> DataFrame:
    """One row: nll per token, macro nll per choice, and counts."""
    keyed = frame.groupBy("experiment", "participant").agg(
        F.avg("nll").alias("mean"), F.sum("nll").alias("nll"), F.sum("num_tokens").alias("tokens"), F.count("*").alias("choices")
    )
    tasks = keyed.groupBy("experiment").agg(*(F.sum(c).alias(c) for c in ("nll", "tokens", "choices")), F.avg("mean").alias("mean"))
    return tasks.agg(
        (F.sum("nll") / F.sum("tokens")).alias("paper_token_nll"),
        F.avg("mean").alias("macro_choice_nll"),
        F.sum("choices").alias("choices"),
        F.sum("tokens").alias("tokens"),
    )


def run_report(frame: DataFrame) -> DataFrame:
    """run_summary with the number of different participants, whose names may recur between tasks."""
    people = frame.agg(F.countDistinct("participant").alias("participants"))
    both = run_summary(frame).unionByName(people, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def condition_totals(frame: DataFrame, order: str) -> DataFrame:
    """condition, place, choices, choice_tokens, token_nll, legal_coverage of every condition; place is the order in which they are first seen."""
    totals = frame.groupBy("condition").agg(
        F.min(order).alias("first"), F.count("*").alias("choices"), F.sum("num_tokens").alias("choice_tokens"), F.sum("nll").alias("nll"),
        F.avg((F.col("options_status") == "scored").cast("double")).alias("legal_coverage"),
    )
    place = F.row_number().over(Window.orderBy("first")) - 1  # one row per condition
    return totals.select("condition", place.cast("long").alias("place"), "choices", "choice_tokens", (F.col("nll") / F.col("choice_tokens")).alias("token_nll"), "legal_coverage")


def threshold_flags(table: DataFrame, first: Column, second: Column, threshold: float) -> DataFrame:
    """table with flags: which of two numbers exceed a threshold: `both`, `first`, `second` or `neither`. A null exceeds nothing."""
    a, b = (F.coalesce(x > threshold, F.lit(False)) for x in (first, second))
    return table.withColumn("flags", F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither"))


def extremes(table: DataFrame, value: str, n: int, key: str = "experiment") -> DataFrame:
    """The n rows of the least values and the n of the largest, with side and place from 0; ties go by key."""
    sides = []
    for side, order in (("least", F.asc(value)), ("largest", F.desc(value))):
        top = table.where(F.col(value).isNotNull()).orderBy(order, key).limit(n)
        place = F.row_number().over(Window.orderBy(order, key)) - 1  # of n rows
        sides.append(top.withColumn("side", F.lit(side)).withColumn("place", place.cast("long")))
    return sides[0].unionByName(sides[1])


def sorted_report(table: DataFrame, keys: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """table in the order of its keys, nulls last."""
    return table.orderBy(*(F.desc_nulls_last(k) if k in descending else F.asc_nulls_last(k) for k in keys))


def missing_models(runs: DataFrame) -> DataFrame:
    """comparability() with missing_models: the models that a task lacks, by name and with commas; runs has model, experiment, participant."""
    models = [r["model"] for r in runs.select("model").distinct().orderBy("model").collect()]  # one per run
    have = runs.groupBy("experiment").agg(F.collect_set("model").alias("have"))
    lacking = F.array_join(F.array_except(F.array(*map(F.lit, models)), "have"), ",")
    return comparability(runs).join(have, "experiment").withColumn("missing_models", lacking).drop("have")


def paper_summary(frame: DataFrame, task: str = "experiment") -> DataFrame:
    """Per task: mean over sessions of nll per token, nll per token over all, and sessions."""
    sessions = frame.groupBy(task, "experiment", "participant") if task != "experiment" else frame.groupBy("experiment", "participant")
    each = sessions.agg(F.sum("nll").alias("nll"), F.sum("num_tokens").alias("tokens"), F.count("*").alias("choices"))
    return each.groupBy(task).agg(
        F.avg(F.col("nll") / F.col("tokens")).alias("session_mean"), (F.sum("nll") / F.sum("tokens")).alias("micro"), F.count("*").alias("sessions"), F.sum("choices").alias("choices")
    )


def comparability(runs: DataFrame) -> DataFrame:
    """Tasks whose models didn't cover the same participants. runs has model, experiment, participant.

    experiment, n_shared, n_seen, n_models: participants that every present model has, that any has, and present models.
    """
    everyone = runs.select("model").distinct().count()
    pairs = runs.select("model", "experiment", "participant").distinct()
    present = pairs.groupBy("experiment").agg(F.countDistinct("model").alias("n_models"))
    each = pairs.groupBy("experiment", "participant").agg(F.count("*").alias("has")).join(present, "experiment")
    table = each.groupBy("experiment", "n_models").agg(F.count_if(F.col("has") == F.col("n_models")).alias("n_shared"), F.count("*").alias("n_seen"))
    return table.where((F.col("n_shared") < F.col("n_seen")) | (F.col("n_models") < everyone)).select("experiment", "n_shared", "n_seen", "n_models")
