"""From randomized key labels to canonical codes: session alignment and the key dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import canonical_code, is_option, number
from ..schemas import SESSION

BLOCK = [*SESSION, "block"]
#: Row rules in the order in which they are tried.
RULES = ["raw", "forced==0", "code>=0"]


def align_sessions(choices: DataFrame, table: DataFrame) -> DataFrame:
    """experiment, participant, choice_index, block, code, label, rule of every choice with a code.

    table has experiment, participant, row_idx, value, forced, block in trial order. The first rule that leaves as many rows
    as the session has choices pairs the two by their order; sessions that no rule fits are left out.
    """
    value = F.col("value")
    numeric = isinstance(table.schema["value"].dataType, T.DoubleType)  # needs no reading from text
    answered = (value if numeric else number(value.cast("string"))) >= 0
    keeps = {"raw": F.lit(True), "forced==0": F.col("forced") == 0, "code>=0": answered}
    keeps = {r: F.col("of_table") & F.coalesce(c, F.lit(False)) for r, c in keeps.items()}
    said = choices.select(*SESSION, F.lit(False).alias("of_table"), "choice_index", F.col("human_choice").alias("label"))
    rows = table.select(*SESSION, F.lit(True).alias("of_table"), "row_idx", "value", "forced", "block")
    both = said.unionByName(rows, allowMissingColumns=True).na.drop(subset=SESSION)
    # choices and rows of a session stand side by side in one sort, so that neither is made or shuffled again to be counted and paired
    session = Window.partitionBy(*SESSION).orderBy("of_table", "choice_index", "row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length, has_forced = F.count_if(~F.col("of_table")).over(session), F.count("forced").over(session)
    fits = [F.when((F.count_if(keeps[r]).over(session) == length) & (F.lit(r != "forced==0") | (has_forced > 0)), F.lit(r)) for r in RULES]
    ruled = both.withColumn("rule", F.coalesce(*fits)).where("rule is not null")
    kept = ruled.where(~F.col("of_table") | F.coalesce(*(F.when(F.col("rule") == r, c) for r, c in keeps.items())))
    place = F.row_number().over(Window.partitionBy(*SESSION, "of_table").orderBy("choice_index", "row_idx"))
    placed = kept.select(*SESSION, "of_table", "choice_index", "label", "rule", "block", canonical_code(value, numeric).alias("code"), place.alias("ordinal"))
    # a choice is followed by the row of its ordinal, as there are as many of either
    pair = Window.partitionBy(*SESSION).orderBy("ordinal", "of_table")
    paired = placed.withColumn("block", F.lead("block").over(pair)).withColumn("code", F.lead("code").over(pair))
    return paired.where(~F.col("of_table") & F.col("code").isNotNull()).select(*SESSION, "choice_index", "block", "code", "label", "rule")


def alignment_report(choices: DataFrame, aligned: DataFrame) -> DataFrame:
    """experiment, n_sessions, n_aligned, rules."""
    all_sessions = choices.groupBy("experiment").agg(F.countDistinct("participant").alias("n_sessions"))
    fitted = aligned.groupBy("experiment").agg(F.countDistinct("participant").alias("n_aligned"), F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))
    joined = all_sessions.join(fitted, "experiment", "left")
    return joined.select("experiment", "n_sessions", F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), F.coalesce("rules", F.lit("")).alias("rules"))


def unaligned_sessions(choices: DataFrame, table: DataFrame) -> DataFrame:
    """experiment, participant, n_choices, n_rows, reason of the sessions that no rule fits: `no_table`, or `row_counts` where none leaves as many rows."""
    aligned = align_sessions(choices, table).select(*SESSION).distinct()
    lengths = choices.groupBy(*SESSION).agg(F.count("*").alias("n_choices")).join(aligned, SESSION, "left_anti")
    rows = table.groupBy(*SESSION).agg(F.count("*").alias("n_rows"))
    reason = F.when(F.col("n_rows").isNull(), "no_table").otherwise("row_counts")
    return lengths.join(rows, SESSION, "left").select(*SESSION, "n_choices", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), reason.alias("reason"))


def label_map(aligned: DataFrame, offered: DataFrame) -> DataFrame:
    """experiment, participant, block, label, code, source: which code each label stands for in each block.

    A block counts if each of its labels has one code and no two labels share one. A block with a single unused code (of
    those that anybody has there) and a single unclaimed label (of those that the session offers) gets that pair too.
    offered has experiment, participant, option.
    """
    pressed = aligned.select(*BLOCK, "label", "code").distinct()
    entry = F.struct("label", "code", F.lit("pressed").alias("source"))
    blocks = pressed.groupBy(*BLOCK).agg(F.collect_list(entry).alias("entries"))
    good = blocks.where(" and ".join(f"size(entries) = size(array_distinct(entries.{c}))" for c in ("label", "code")))
    pool = aligned.select("experiment", "block", "code").distinct().groupBy("experiment", "block").agg(F.collect_list("code").alias("all_codes"))
    options = offered.groupBy(*SESSION).agg(F.collect_set("option").alias("options"))
    # a row per session: a merge, whatever its table's bytes on disk have Spark expect
    rest = good.join(pool, ["experiment", "block"]).join(options.hint("merge"), SESSION, "left")
    free, spare = F.array_except("all_codes", "entries.code"), F.array_except("options", "entries.label")
    forced = F.array(F.struct(F.get(spare, F.lit(0)).alias("label"), F.get(free, F.lit(0)).alias("code"), F.lit("elimination").alias("source")))
    every = F.when((F.size(free) == 1) & (F.size(spare) == 1), F.concat("entries", forced)).otherwise(F.col("entries"))
    return rest.select(*BLOCK, F.inline(every))


def option_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """experiment, n_options: distinct answers over all the code columns."""
    long = table.select("experiment", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("experiment", columns, "column", "value")
    return long.where(is_option(F.col("value"))).groupBy("experiment").agg(F.countDistinct("value").alias("n_options"))
