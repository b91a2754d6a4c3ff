"""Counting baselines of choice sequences, within a session and over a population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SESSION

BASELINES = ["uniform", "base_rate", "sticky", "bigram"]


def _previous(frame: DataFrame, label: str, order: str, by: Sequence[str] = SESSION) -> DataFrame:
    return frame.withColumn("previous", F.lag(label).over(Window.partitionBy(*by).orderBy(order)))


def online(frame: DataFrame, label: str = "human_choice", order: str = "choice_index", smoothing: float = 0.5) -> DataFrame:
    """Negative log-likelihood of each choice from the counts of earlier choices of its session only.

    Every window is partitioned by the session, so the rows are dealt once. The session's set of labels counts as known.
    """
    frame = _previous(frame, label, order)
    session = Window.partitionBy(*SESSION)
    earlier = lambda *more: Window.partitionBy(*SESSION, *more).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("previous").isNotNull().cast("int")
    counted = (
        frame.withColumn("k", F.size(F.collect_set(label).over(session)))
        .withColumn("seen", F.count("*").over(earlier()))
        .withColumn("of_label", F.count("*").over(earlier(label)))
        .withColumn("of_pair", F.count("*").over(earlier("previous", label)))
        .withColumn("of_previous", F.count("*").over(earlier("previous")))
        .withColumn("steps", F.coalesce(F.sum(moved).over(earlier()), F.lit(0)))
        .withColumn("repeats", F.coalesce(F.sum((F.col("previous") == F.col(label)).cast("int")).over(earlier()), F.lit(0)))
    )
    k, s = F.col("k"), F.lit(smoothing)
    base = (F.col("of_label") + s) / (F.col("seen") + s * k)
    stays = (F.col("repeats") + s) / (F.col("steps") + 2 * s)
    sticky = F.when(F.col(label) == F.col("previous"), stays).otherwise((1 - stays) / F.nullif(k - 1, F.lit(0)))
    pair = (F.col("of_pair") + s) / (F.col("of_previous") + s * k)
    alone, start = k == 1, F.col("previous").isNull()
    pick = lambda p: F.when(alone, F.lit(1.0)).when(start, base).otherwise(p)
    nll = {"uniform": F.ln(k.cast("double")), "base_rate": -F.ln(base), "sticky": -F.ln(pick(sticky)), "bigram": -F.ln(pick(pair))}
    return counted.select(*SESSION, order, *(x.alias(n) for n, x in nll.items()))


def sequence_tables(train: DataFrame, label: str = "human_choice", order: str = "choice_index") -> dict[str, DataFrame]:
    """Counts per experiment as long tables: labels, pairs and totals."""
    frame = _previous(train, label, order)
    moved = frame.where(F.col("previous").isNotNull())
    totals = frame.groupBy("experiment").agg(
        F.count("*").alias("n"), F.count("previous").alias("steps"), F.count_if(F.col("previous") == F.col(label)).alias("repeats"), F.countDistinct(label).alias("k")
    )
    return {
        "labels": frame.groupBy("experiment", F.col(label).alias("label")).agg(F.count("*").alias("of_label")),
        "pairs": moved.groupBy("experiment", "previous", F.col(label).alias("label")).agg(F.count("*").alias("of_pair")),
        "leading": moved.groupBy("experiment", "previous").agg(F.count("*").alias("of_previous")),
        "totals": totals,
    }


def _within_support(rows: DataFrame, support: DataFrame, label: str) -> DataFrame:
    known = support.select("experiment", F.col("label").alias(label), F.lit(True).alias("known")).distinct()
    joined = rows.join(known, ["experiment", label], "left")
    ok = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("a label beyond the support: "), F.coalesce(F.col(label), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return joined.where(ok).select(*rows.columns)


def population(train: DataFrame, test: DataFrame, support: DataFrame, smoothing: float = 1.0, label: str = "human_choice", order: str = "choice_index") -> DataFrame:
    """Laplace-smoothed marginal and bigram of the training choices, scored on test.

    support (experiment, label) is the task's full set of labels; a label of test beyond it fails the query, since it has no
    probability. A session's first choice has the marginal as its bigram.
    """
    test = _within_support(test, support, label)
    counts = sequence_tables(train, label, order)
    k = support.groupBy("experiment").agg(F.count("*").alias("k"))
    n = counts["totals"].select("experiment", "n")
    rows = _previous(test, label, order).withColumnRenamed(label, "label")
    joined = (
        rows.join(k, "experiment").join(n, "experiment", "left").join(counts["labels"], ["experiment", "label"], "left")
        .join(counts["pairs"], ["experiment", "previous", "label"], "left").join(counts["leading"], ["experiment", "previous"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    marginal = (zero("of_label") + smoothing) / (zero("n") + smoothing * F.col("k"))
    pair = F.when(F.col("previous").isNull(), marginal).otherwise((zero("of_pair") + smoothing) / (zero("of_previous") + smoothing * F.col("k")))
    return joined.select(*SESSION, order, (-F.ln(marginal)).alias("pop_base_rate"), (-F.ln(pair)).alias("pop_bigram"), F.ln(F.col("k").cast("double")).alias("canonical_uniform"))


def guesses(frame: DataFrame, rule: str, label: str = "human_choice", order: str = "choice_index") -> DataFrame:
    """experiment, participant, choice_index, label, guess by a counting rule that sees earlier choices of the session only.

    `base_rate`: the label seen most often; `sticky`: the last label; `bigram`: what followed the last label most often, or
    the base rate where nothing did yet. Of equals the one seen first wins. A session's first choice has no guess.
    """
    if rule == "base_rate":
        return running_guess(frame, label, order)
    moved = _previous(frame, label, order)
    if rule == "sticky":
        return moved.where(F.col("previous").isNotNull()).select(*SESSION, order, label, F.col("previous").alias("guess"))
    if rule != "bigram":
        raise ValueError(f"unknown rule {rule!r}")
    pair = Window.partitionBy(*SESSION, "previous", label)
    count = F.count("*").over(pair.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    event = moved.withColumn("event", F.struct(count.alias("n"), (-F.min(order).over(pair)).alias("first"), F.col(label).alias("label")))
    before = Window.partitionBy(*SESSION, "previous").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    followed = event.where(F.col("previous").isNotNull()).select(*SESSION, order, F.max("event").over(before)["label"].alias("follower"))
    base = running_guess(frame, label, order)
    return base.join(followed, [*SESSION, order]).select(*SESSION, order, label, F.coalesce("follower", "guess").alias("guess"))


def prequential(frame: DataFrame, label: str = "human_choice", order: str = "choice_index") -> DataFrame:
    """experiment, participant and the share of right guesses by each rule, over all choices but the first; uniform is 1 / labels of the session."""
    out = frame.groupBy(*SESSION).agg((1 / F.countDistinct(label)).alias("uniform"))
    for rule in BASELINES[1:]:
        hits = guesses(frame, rule, label, order).groupBy(*SESSION).agg(F.avg((F.col("guess") == F.col(label)).cast("double")).alias(rule))
        out = out.join(hits, SESSION, "left")
    return out


def running_guess(frame: DataFrame, label: str = "human_choice", order: str = "choice_index") -> DataFrame:
    """Per choice but the first of a session: the label seen most often before it; of equals, the one seen first.

    A candidate's running count only changes where it occurs, so each occurrence is kept as an event and the best event so
    far wins: the highest count, then the earliest first sight. The winner of a prefix is the running maximum of
    (count, -first place), since a label's latest event has its highest count.
    """
    first = F.min(order).over(Window.partitionBy(*SESSION, label))
    count = F.count("*").over(Window.partitionBy(*SESSION, label).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    event = frame.withColumn("event", F.struct(count.alias("n"), (-first).alias("first"), F.col(label).alias("label")))
    before = Window.partitionBy(*SESSION).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    guessed = event.withColumn("guess", F.max("event").over(before)["label"])
    return guessed.where(F.col("guess").isNotNull()).select(*SESSION, order, label, "guess")
