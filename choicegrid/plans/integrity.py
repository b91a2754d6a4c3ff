"""Shards, replays, orphans and receipts over runs made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity
from ..schemas import CHOICE, SESSION
from ..sources import testdata as data
from ..sources.writers import receipts
from .registry import query

C = f"WITH {data.CHOICES}"
SHARDS = (
    C
    + """, shards AS (
  SELECT experiment, participant, choice_index, human_choice, num_tokens, CAST(participant AS INTEGER) % 4 AS shard, event_id AS row_idx FROM choices
  UNION ALL SELECT experiment, participant, choice_index, human_choice, num_tokens, CAST(participant AS INTEGER) % 4, event_id + 1000000000 FROM choices WHERE event_id % 9 = 0)"""
)


def _shards(spark, sf_dir):
    """Prediction rows in four shards, every ninth one replayed."""
    rows = data.choices(spark, sf_dir).select(*CHOICE, "human_choice", "num_tokens", (F.col("participant").cast("int") % 4).alias("shard"), F.col("event_id").alias("row_idx"))
    again = rows.where(F.col("row_idx") % 9 == 0).withColumn("row_idx", F.col("row_idx") + 1_000_000_000)
    return rows.unionByName(again)


@query("merge_predictions_dedup", f"{SHARDS} SELECT experiment, participant, choice_index, any_value(shard) AS shard, count(*) AS copies, any_value(human_choice) AS human_choice, any_value(num_tokens) AS num_tokens FROM shards GROUP BY 1, 2, 3")
def merge_predictions_dedup(spark, sf_dir):
    return integrity.merge_predictions(_shards(spark, sf_dir), CHOICE, ["human_choice", "num_tokens"])


@query("merge_violations", f"{SHARDS}, bad AS (SELECT * REPLACE (CASE WHEN row_idx > 1000000000 AND choice_index = 0 THEN shard + 1 ELSE shard END AS shard, CASE WHEN row_idx > 1000000000 AND choice_index = 1 THEN num_tokens + 1 ELSE num_tokens END AS num_tokens) FROM shards) SELECT experiment, participant, choice_index, CASE WHEN count(DISTINCT shard) > 1 THEN 'crosses_shards' ELSE 'replay_differs' END AS rule FROM bad GROUP BY 1, 2, 3 HAVING count(DISTINCT shard) > 1 OR count(DISTINCT num_tokens) > 1")
def merge_violations(spark, sf_dir):
    rows, replay = _shards(spark, sf_dir), F.col("row_idx") > 1_000_000_000
    bad = rows.withColumn("shard", F.when(replay & (F.col("choice_index") == 0), F.col("shard") + 1).otherwise(F.col("shard")))
    bad = bad.withColumn("num_tokens", F.when(replay & (F.col("choice_index") == 1), F.col("num_tokens") + 1).otherwise(F.col("num_tokens")))
    return integrity.merge_violations(bad, CHOICE, ["human_choice", "num_tokens"])


def _children(spark, sf_dir):
    """Top-token rows: num_tokens times two per choice; some parents lack, some rows are missing or twice."""
    rows = data.choices(spark, sf_dir)
    e = F.col("event_id")
    one = rows.select(*CHOICE, "event_id", "num_tokens", F.explode(F.sequence(F.lit(0), F.col("num_tokens") * 2 - 1)).alias("k"))
    return one.select(*CHOICE, "event_id", "num_tokens", F.floor(F.col("k") / 2).alias("token_index"), (F.col("k") % 2).alias("rank")).where(~((e % 17 == 0) & (F.col("token_index") == 0) & (F.col("rank") == 1)))


CHILDREN = C + ", children AS (SELECT experiment, participant, choice_index, event_id, num_tokens, k // 2 AS token_index, k % 2 AS rank FROM choices, range(0, 4) AS r(k) WHERE choice_index < 5 AND k < num_tokens * 2 AND NOT (event_id % 17 = 0 AND k = 1)), parents AS (SELECT experiment, participant, choice_index, num_tokens * 2 AS expected FROM choices WHERE choice_index < 5 AND event_id % 23 <> 0)"

#: Every choice of every session is a parent; a choice has as many children as its tokens say.
ALL_CHILDREN = C + ", children AS (SELECT experiment, participant, choice_index, event_id, num_tokens, k // 2 AS token_index, k % 2 AS rank FROM (SELECT *, unnest(range(0, num_tokens * 2)) AS k FROM choices) WHERE NOT (event_id % 17 = 0 AND k = 1)), parents AS (SELECT experiment, participant, choice_index, num_tokens * 2 AS expected FROM choices WHERE event_id % 23 <> 0)"
#: The SQL of two older queries holds these choices only; their twins named all_ take every choice.
FIRST = "choice_index < 5"
ORPHANS = "SELECT c.experiment, c.participant, c.choice_index, token_index, rank FROM children c ANTI JOIN parents USING (experiment, participant, choice_index)"
INCOMPLETE = ", f AS (SELECT experiment, participant, choice_index, count(DISTINCT (token_index, rank)) AS found FROM children GROUP BY 1, 2, 3) SELECT experiment, participant, choice_index, expected, coalesce(found, 0) AS found FROM parents LEFT JOIN f USING (experiment, participant, choice_index) WHERE expected <> coalesce(found, 0)"


def _parents(spark, sf_dir):
    return data.choices(spark, sf_dir).where(F.col("event_id") % 23 != 0).select(*CHOICE, (F.col("num_tokens") * 2).alias("expected"))


@query("orphan_children", f"{CHILDREN} SELECT c.experiment, c.participant, c.choice_index, token_index, rank FROM children c ANTI JOIN parents USING (experiment, participant, choice_index)")
def orphan_children(spark, sf_dir):
    return all_orphan_children(spark, sf_dir).where(FIRST)


@query("all_orphan_children", f"{ALL_CHILDREN} {ORPHANS}")
def all_orphan_children(spark, sf_dir):
    found = integrity.orphans(_children(spark, sf_dir), _parents(spark, sf_dir), CHOICE)
    return found.select(*CHOICE, "token_index", F.col("rank").cast("long").alias("rank"))


@query("child_completeness", f"{CHILDREN}, f AS (SELECT experiment, participant, choice_index, count(DISTINCT (token_index, rank)) AS found FROM children GROUP BY 1, 2, 3) SELECT experiment, participant, choice_index, expected, coalesce(found, 0) AS found FROM parents LEFT JOIN f USING (experiment, participant, choice_index) WHERE expected <> coalesce(found, 0)")
def child_completeness(spark, sf_dir):
    return all_child_completeness(spark, sf_dir).where(FIRST)


@query("all_child_completeness", f"{ALL_CHILDREN}{INCOMPLETE}")
def all_child_completeness(spark, sf_dir):
    return integrity.incomplete(_children(spark, sf_dir), _parents(spark, sf_dir), CHOICE, ["token_index", "rank"])


#: A choice's rows come once as they are and once whole; the first time some lack one.
OCCURRENCES = f"{ALL_CHILDREN}, each_one AS (SELECT experiment, participant, choice_index, count(*) AS first_rows, any_value(num_tokens) * 2 AS whole FROM children GROUP BY 1, 2, 3), k AS (SELECT e.*, p.expected FROM each_one e LEFT JOIN parents p USING (experiment, participant, choice_index)), n AS (SELECT outcome, sum(n) AS n, count(*) AS parents FROM (SELECT 'orphan' AS outcome, first_rows + whole AS n FROM k WHERE expected IS NULL UNION ALL SELECT 'kept', whole FROM k WHERE expected IS NOT NULL UNION ALL SELECT 'replay', whole FROM k WHERE expected IS NOT NULL AND first_rows = whole UNION ALL SELECT 'incomplete', first_rows FROM k WHERE expected IS NOT NULL AND first_rows < whole) GROUP BY 1) SELECT outcome, CAST(n AS BIGINT) AS n, parents FROM n"


@query("occurrence_merge", OCCURRENCES)
def occurrence_merge(spark, sf_dir):
    """Children written twice: whole in the replay, the first time some are cut short."""
    rows = _children(spark, sf_dir).drop("num_tokens")
    whole = data.choices(spark, sf_dir).select(*CHOICE, "event_id", F.explode(F.sequence(F.lit(0), F.col("num_tokens") * 2 - 1)).alias("k"))
    whole = whole.select(*CHOICE, "event_id", F.floor(F.col("k") / 2).alias("token_index"), (F.col("k") % 2).alias("rank"))
    place = lambda f, add: f.withColumn("shard", F.col("participant").cast("int") % 4).withColumn("row_idx", F.col("event_id") * 8 + F.col("token_index") * 2 + F.col("rank") + add).drop("event_id")
    both = place(rows, 0).unionByName(place(whole, 1_000_000_000_000))
    out = integrity.merge_occurrences(both, _parents(spark, sf_dir), CHOICE, ["token_index", "rank"])
    return out.groupBy("outcome").agg(F.sum("n").alias("n"), F.count("*").alias("parents"))


@query("commit_violations", f"{C} SELECT experiment, participant, CASE CAST(participant AS INTEGER) % 10 WHEN 1 THEN 'count' WHEN 2 THEN 'sum' WHEN 3 THEN 'no_commit' END AS rule FROM (SELECT DISTINCT experiment, participant FROM choices) WHERE CAST(participant AS INTEGER) % 10 IN (1, 2, 3)")
def commit_violations(spark, sf_dir):
    rows = data.choices(spark, sf_dir).withColumn("condition", F.when(F.col("choice_index") % 2 == 0, "full").otherwise("w0"))
    tens = F.col("participant").cast("int") % 10
    commits = receipts(rows).where(tens != 3)
    more = F.when(tens == 2, 1).when(tens == 1, 2).otherwise(0)
    commits = commits.withColumn("prediction_rows", F.col("prediction_rows") + more)
    commits = commits.withColumn("conditions", F.when(tens == 1, F.map_concat("conditions", F.create_map(F.lit("extra"), F.lit(2).cast("long")))).otherwise(F.col("conditions")))
    return integrity.commit_violations(commits, rows)


@query("receipts", f"{C} SELECT experiment, participant, count(*) AS prediction_rows, sha256('[\"' || experiment || '\",\"' || participant || '\"]') AS digest FROM choices GROUP BY 1, 2")
def session_receipts(spark, sf_dir):
    rows = data.choices(spark, sf_dir).withColumn("condition", F.lit("full"))
    return receipts(rows).select(*SESSION, "prediction_rows", "digest")
