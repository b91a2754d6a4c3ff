"""Which sessions a run takes: limits, samples, shards, skips. The order of the input is a column, never assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import choices, header, segments, tail
from .quantiles import exact_quantile


def prefix_limit(rows: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first n rows by order."""
    return rows.orderBy(order).limit(n)


def hash_order(seed: int, *keys: str) -> Column:
    """A shuffled order that depends on the seed and the keys only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_per_group(rows: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, *keys)))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def modulo_shard(rows: DataFrame, k: int, n: int, order: str = "row_idx") -> DataFrame:
    """Every n-th row by a dense row number, from the k-th on."""
    return rows.where(F.pmod(F.col(order), F.lit(n)) == k)


def split_by_length(rows: DataFrame, most: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of at most `most` characters, the rest)."""
    fits = F.length(text) <= most
    return rows.where(fits), rows.where(~F.coalesce(fits, F.lit(False)))


def skip_report(rows: DataFrame, most: int) -> DataFrame:
    """experiment, skipped, total, median_chars (of the skipped), whole_task of the tasks with skipped sessions."""
    long = F.length("text") > most
    table = rows.groupBy("experiment").agg(F.count_if(long).alias("skipped"), F.count("*").alias("total")).where("skipped > 0")
    middle = exact_quantile(rows.where(long).select("experiment", F.length("text").alias("chars")), ["experiment"], "chars", 0.5)
    return table.join(middle, "experiment").select("experiment", "skipped", "total", F.floor("quantile").cast("long").alias("median_chars"), (F.col("skipped") == F.col("total")).alias("whole_task"))


def nonempty(rows: DataFrame, what: str = "rows") -> DataFrame:
    """rows; a selection that leaves none is an error."""
    if rows.isEmpty():
        raise ValueError(f"no {what} left")
    return rows


def unreadable(rows: DataFrame, text: str = "text") -> DataFrame:
    """experiment, participant, problem of sessions whose text has no marked choice (`unmarked`) or an empty one (`empty_mark`)."""
    labels = choices(F.col(text))
    problem = F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, "unmarked").when(F.exists(labels, lambda x: x == ""), "empty_mark")
    return rows.select("experiment", "participant", problem.alias("problem")).where("problem is not null")


def lossy_segments(rows: DataFrame, text: str = "text") -> DataFrame:
    """experiment, participant of marked sessions whose header, segments and tail don't give their text back."""
    t = F.col(text)
    whole = F.concat(header(t), F.array_join(segments(t), ""), tail(t))
    return rows.where((F.instr(t, "<<") > 0) & ~F.coalesce(whole == t, F.lit(False))).select("experiment", "participant")


def split_train_eval(rows: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows by a hash of their keys; a fraction of 0, or fewer than two rows, gives all rows to both."""
    if fraction <= 0 or len(rows.take(2)) < 2:
        return rows, rows
    eval_part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return rows.where(~eval_part), rows.where(eval_part)
