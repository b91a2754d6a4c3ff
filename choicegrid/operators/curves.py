"""Metrics along a session: by position, by context window, by anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of_ten
from ..schemas import CHOICE, SESSION
from .metrics import macro, task_table, unique_by

#: Sort value of the unlimited window.
FULL = 1_000_000


def positions(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds rank and decile within the session (and source, where by says so)."""
    keys = by or SESSION
    ordered = Window.partitionBy(*keys).orderBy("choice_index")
    frame = frame.withColumn("rank", F.row_number().over(ordered).cast("long") - 1)
    return frame.withColumn("decile", bucket_of_ten(F.col("rank"), F.count("*").over(Window.partitionBy(*keys))))


def session_curve(frame: DataFrame, absolute: int = 50) -> DataFrame:
    """source, axis, experiment, bucket and the task table of each bucket; frame has source."""
    placed = positions(frame, ["source", *SESSION])
    parts = [
        placed.select("source", *SESSION, "nll", F.lit("decile").alias("axis"), F.col("decile").cast("long").alias("bucket")),
        placed.where(F.col("rank") < absolute).select("source", *SESSION, "nll", F.lit("absolute").alias("axis"), F.col("rank").alias("bucket")),
    ]
    return task_table(parts[0].unionByName(parts[1]), "nll", ["source", "axis", "experiment", "bucket"])


def source_curves(model: DataFrame, scored: DataFrame, baselines: list[str], name: str = "model", absolute: int = 50) -> DataFrame:
    """What session_curve gives for the rows of with_baselines, but with the baselines side by side in a row until they are averaged.

    A session's choices are placed once for the model and once for all baselines, instead of once per source.
    """
    ours = unique_by(model.select(*CHOICE, "nll"), CHOICE)
    theirs = unique_by(scored.select(*CHOICE, *baselines), CHOICE).join(ours.select(*CHOICE), CHOICE, "left_semi")
    tables = []
    for rows, values in ((ours.withColumnRenamed("nll", name), [name]), (theirs, baselines)):
        placed = positions(rows)
        buckets = F.array(F.struct(F.lit("decile").alias("axis"), F.col("decile").cast("long").alias("bucket")), F.when(F.col("rank") < absolute, F.struct(F.lit("absolute").alias("axis"), F.col("rank").alias("bucket"))))
        each = placed.select(*SESSION, *values, F.inline(F.array_compact(buckets)))
        keys = ["axis", "experiment", "bucket"]
        table = macro(each, values, keys)
        tables.append(table.unpivot([*keys, "n_participants", "n_choices"], values, "source", "task_nll"))
    return tables[0].unionByName(tables[1]).withColumn("task_probability", F.exp(-F.col("task_nll")))


def with_baselines(model: DataFrame, scored: DataFrame, baselines: list[str], name: str = "model") -> DataFrame:
    """source, experiment, participant, choice_index, nll of the model and of each baseline, over the model's own choices only.

    scored has a column per baseline. A choice that either side has twice fails the query.
    """
    ours = unique_by(model.select(*CHOICE, "nll"), CHOICE)
    theirs = unique_by(scored.select(*CHOICE, *baselines), CHOICE).join(ours.select(*CHOICE), CHOICE, "left_semi")
    return ours.withColumn("source", F.lit(name)).unionByName(theirs.unpivot(CHOICE, baselines, "source", "nll"))


def anchored(windows: DataFrame, full: DataFrame) -> DataFrame:
    """The anchor choices under all windows, the unlimited one included.

    windows has window, target_index, effective_window; full has every choice once. An anchor that full lacks, or a choice
    that it has twice, fails the query.
    """
    anchors = windows.select(*CHOICE, "target_index").distinct()
    joined = anchors.join(unique_by(full.select(*CHOICE, "nll"), CHOICE), CHOICE, "left")
    nll = F.when(F.col("nll").isNull(), F.raise_error(F.lit("an anchor is missing from the full condition")).cast("double")).otherwise(F.col("nll"))
    unlimited = joined.select(*CHOICE, nll.alias("nll"), F.lit(FULL).alias("window"), "target_index", F.col("target_index").alias("effective_window"))
    return windows.select(*CHOICE, "nll", "window", "target_index", "effective_window").unionByName(unlimited)


def context_curve(frame: DataFrame, by: str = "window", least_target: int = 0) -> DataFrame:
    """Task table per window (or effective window), over targets that aren't cut short by the session's start."""
    return task_table(frame.where(F.col("target_index") >= least_target), "nll", ["experiment", by])


def anchor_rank(frame: DataFrame) -> DataFrame:
    """Adds anchor_rank: which of the session's targets each row has, from 0."""
    return frame.withColumn("anchor_rank", F.dense_rank().over(Window.partitionBy(*SESSION).orderBy("target_index")).cast("long") - 1)


def numerical_floor(frame: DataFrame) -> DataFrame:
    """experiment, participant, choice_index, gap: no window against the unlimited one at target 0, where both see the same text."""
    zero = frame.where("target_index = 0").groupBy(*CHOICE).agg(F.avg(F.when(F.col("window") == 0, F.col("nll"))).alias("a"), F.avg(F.when(F.col("window") == FULL, F.col("nll"))).alias("b"))
    return zero.where("a is not null and b is not null").select(*CHOICE, F.abs(F.col("a") - F.col("b")).alias("gap"))


def adaptation_drop(frame: DataFrame) -> DataFrame:
    """experiment, first_decile, last_decile, drop: macro nll of the first tenth of a session minus that of the last tenth present."""
    table = task_table(positions(frame), "nll", ["experiment", "decile"])
    ends = table.groupBy("experiment").agg(F.min_by("task_nll", "decile").alias("first_decile"), F.max_by("task_nll", "decile").alias("last_decile"))
    return ends.withColumn("drop", F.col("first_decile") - F.col("last_decile"))


def window_gaps(frame: DataFrame) -> DataFrame:
    """experiment, window, token_nll, gap: nll per token averaged over sessions, and how much it exceeds the unlimited window's."""
    sessions = frame.groupBy("experiment", "participant", "window").agg((F.sum("nll") / F.sum("num_tokens")).alias("x"))
    tasks = sessions.groupBy("experiment", "window").agg(F.avg("x").alias("token_nll"))
    best = F.max(F.when(F.col("window") == FULL, F.col("token_nll"))).over(Window.partitionBy("experiment"))
    return tasks.withColumn("gap", F.col("token_nll") - best)


def trial_macro(frame: DataFrame, upto: int = 10, least_length: int | None = None) -> DataFrame:
    """choice_index, nll, n_tasks: at each of the first choices, mean over participants and then tasks; of long enough sessions only."""
    if least_length is not None:
        frame = frame.withColumn("length", F.max("choice_index").over(Window.partitionBy(*SESSION)) + 1).where(F.col("length") >= least_length)
    tasks = task_table(frame.where(F.col("choice_index") < upto), "nll", ["experiment", "choice_index"])
    return tasks.groupBy("choice_index").agg(F.avg("task_nll").alias("nll"), F.count("*").alias("n_tasks"))
