"""Reports that put several tables together: totals, flags, extremes, distributions by task, curves with baselines, merges, scores."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import supervision as sv
from ..functions import text as tx
from ..functions.scalars import canonical_code, short_name, table_folder
from ..operators import baselines, canonical, curves, integrity, merge, metrics, protocol, readouts, runs, sampling, scoring, training_set
from ..operators.quantiles import exact_quantile
from ..schemas import CHOICE, SESSION
from ..sources import readers
from ..sources import testdata as data
from ..sources.files import work_folder, written
from ..sources.writers import shape_scores
from .integrity import SHARDS, _children, _shards
from .likelihood import C, MATCHED, ONLINE, RUNS, SECOND, _matched, _runs, _second_run
from .protocol import TOKENS, _tokens
from .registry import query
from .transcripts import ROWS, S

P = f"WITH {data.PREDICTIONS}"


@query("run_report", f"{C}, s AS (SELECT experiment, participant, avg(nll) AS m FROM choices GROUP BY 1, 2) SELECT round(sum(nll) / sum(num_tokens), 6) AS paper_token_nll, (SELECT round(avg(t), 6) FROM (SELECT avg(m) AS t FROM s GROUP BY experiment)) AS macro_choice_nll, count(*) AS choices, CAST(sum(num_tokens) AS BIGINT) AS tokens, count(DISTINCT participant) AS participants FROM choices")
def run_report(spark, sf_dir):
    return metrics.run_report(data.choices(spark, sf_dir))


CONDITION = "CASE event_id % 3 WHEN 0 THEN 'w1' WHEN 1 THEN 'full' ELSE 'w0' END"


def _conditions(frame):
    return frame.withColumn("condition", F.when(F.col("event_id") % 3 == 0, "w1").when(F.col("event_id") % 3 == 1, "full").otherwise("w0"))


@query("condition_totals", f"{P}, c AS (SELECT *, {CONDITION} AS condition FROM predictions) SELECT condition, row_number() OVER (ORDER BY min(event_id)) - 1 AS place, count(*) AS choices, CAST(sum(num_tokens) AS BIGINT) AS choice_tokens, round(sum(nll) / sum(num_tokens), 6) AS token_nll, round(avg(CAST(options_status = 'scored' AS INTEGER)), 6) AS legal_coverage FROM c GROUP BY 1")
def condition_totals(spark, sf_dir):
    return metrics.condition_totals(_conditions(data.predictions(spark, sf_dir)), "event_id")


MACRO = f"{ONLINE}, m AS (SELECT experiment, avg(uniform) AS uniform, avg(sticky) AS sticky, avg(bigram) AS bigram FROM (SELECT experiment, participant, avg(uniform) AS uniform, avg(sticky) AS sticky, avg(bigram) AS bigram FROM online GROUP BY 1, 2) GROUP BY 1)"


@query("threshold_flags", f"{MACRO} SELECT experiment, CASE WHEN uniform - bigram > 0.02 AND bigram - sticky > 0.02 THEN 'both' WHEN uniform - bigram > 0.02 THEN 'first' WHEN bigram - sticky > 0.02 THEN 'second' ELSE 'neither' END AS flags FROM m")
def threshold_flags(spark, sf_dir):
    table = metrics.macro(baselines.online(data.choices(spark, sf_dir)), ["uniform", "sticky", "bigram"])
    return metrics.threshold_flags(table, F.col("uniform") - F.col("bigram"), F.col("bigram") - F.col("sticky"), 0.02).select("experiment", "flags")


@query("extreme_tasks", f"{MACRO}, r AS (SELECT experiment, bigram, row_number() OVER (ORDER BY bigram, experiment) - 1 AS lo, row_number() OVER (ORDER BY bigram DESC, experiment) - 1 AS hi FROM m) SELECT 'least' AS side, lo AS place, experiment, round(bigram, 6) AS bigram FROM r WHERE lo < 2 UNION ALL SELECT 'largest', hi, experiment, round(bigram, 6) FROM r WHERE hi < 2")
def extreme_tasks(spark, sf_dir):
    table = metrics.macro(baselines.online(data.choices(spark, sf_dir)), ["bigram"]).select("experiment", "bigram")
    return metrics.extremes(table, "bigram", 2)


@query("sorted_report", f"{C} SELECT experiment, count(*) AS n_choices FROM choices GROUP BY 1 ORDER BY n_choices DESC, experiment")
def sorted_report(spark, sf_dir):
    table = data.choices(spark, sf_dir).groupBy("experiment").agg(F.count("*").alias("n_choices"))
    return metrics.sorted_report(table, ["n_choices", "experiment"], ["n_choices"])


@query("missing_models", f"{RUNS}, p AS (SELECT DISTINCT model, experiment, participant FROM runs), k AS (SELECT experiment, count(DISTINCT model) AS m, list(DISTINCT model) AS have FROM p GROUP BY 1), e AS (SELECT experiment, participant, count(*) AS has FROM p GROUP BY 1, 2) SELECT experiment, count(*) FILTER (WHERE has = m) AS n_shared, count(*) AS n_seen, any_value(m) AS n_models, array_to_string(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(any_value(have), x)), ',') AS missing_models FROM e JOIN k USING (experiment) GROUP BY 1 HAVING n_shared < n_seen OR n_models < 3")
def missing_models(spark, sf_dir):
    return metrics.missing_models(_runs(spark, sf_dir))


SOURCES = (
    ONLINE
    + """, second AS (SELECT * REPLACE (nll * (0.9 + (event_id % 7) / 50.0) AS nll) FROM choices WHERE event_id % 11 <> 0),
long AS (UNPIVOT (SELECT experiment, participant, choice_index, uniform, base_rate, sticky, bigram FROM online) ON uniform, base_rate, sticky, bigram INTO NAME source VALUE nll),
src AS (SELECT 'model' AS source, experiment, participant, choice_index, nll FROM second UNION ALL SELECT source, experiment, participant, choice_index, nll FROM long SEMI JOIN second USING (experiment, participant, choice_index)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, experiment, participant ORDER BY choice_index) - 1 AS rank, count(*) OVER (PARTITION BY source, experiment, participant) AS len FROM src),
d AS (SELECT *, CAST(least(rank * 10 // len, 9) AS INTEGER) AS decile FROM placed)"""
)


def _source_sql(axis, bucket, where):
    return f"SELECT source, '{axis}' AS axis, experiment, b AS bucket, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices, round(avg(m), 6) AS task_nll, round(exp(-avg(m)), 6) AS task_probability FROM (SELECT source, experiment, participant, {bucket} AS b, avg(nll) AS m, count(*) AS n FROM d WHERE {where} GROUP BY 1, 2, 3, 4) GROUP BY source, experiment, b"


@query("session_curve_sources", f"{SOURCES} {_source_sql('decile', 'decile', 'true')} UNION ALL {_source_sql('absolute', 'rank', 'rank < 50')}")
def session_curve_sources(spark, sf_dir):
    frame = data.choices(spark, sf_dir, dealt=True)
    return curves.source_curves(_second_run(frame), baselines.online(frame), baselines.BASELINES)


GUESS = (
    C
    + """, l AS (SELECT *, lag(human_choice) OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS prev FROM choices),
g AS (SELECT c.experiment, c.participant, c.choice_index, e.human_choice AS cand, count(*) AS n, min(e.choice_index) AS f FROM choices c JOIN choices e ON c.experiment = e.experiment AND c.participant = e.participant AND e.choice_index < c.choice_index GROUP BY 1, 2, 3, 4),
base AS (SELECT experiment, participant, choice_index, cand FROM g QUALIFY row_number() OVER (PARTITION BY experiment, participant, choice_index ORDER BY n DESC, f) = 1),
h AS (SELECT c.experiment, c.participant, c.choice_index, e.human_choice AS cand, count(*) AS n, min(e.choice_index) AS f FROM l c JOIN l e ON c.experiment = e.experiment AND c.participant = e.participant AND e.prev = c.prev AND e.choice_index < c.choice_index GROUP BY 1, 2, 3, 4),
follow AS (SELECT experiment, participant, choice_index, cand FROM h QUALIFY row_number() OVER (PARTITION BY experiment, participant, choice_index ORDER BY n DESC, f) = 1),
said AS (SELECT l.experiment, l.participant, human_choice, prev, b.cand AS base, coalesce(f.cand, b.cand) AS big FROM l JOIN base b USING (experiment, participant, choice_index) LEFT JOIN follow f USING (experiment, participant, choice_index)),
each_one AS (SELECT experiment, participant, avg(CAST(base = human_choice AS INTEGER)) AS base_rate, avg(CAST(prev = human_choice AS INTEGER)) AS sticky, avg(CAST(big = human_choice AS INTEGER)) AS bigram FROM said GROUP BY 1, 2),
u AS (SELECT experiment, participant, 1.0 / count(DISTINCT human_choice) AS uniform FROM choices GROUP BY 1, 2)"""
)


@query("prequential_rules", f"{GUESS} SELECT experiment, round(avg(uniform), 6) AS uniform, round(avg(base_rate), 6) AS base_rate, round(avg(sticky), 6) AS sticky, round(avg(bigram), 6) AS bigram FROM u LEFT JOIN each_one USING (experiment, participant) GROUP BY 1")
def prequential_rules(spark, sf_dir):
    return baselines.prequential(data.choices(spark, sf_dir)).groupBy("experiment").agg(*(F.avg(b).alias(b) for b in baselines.BASELINES))


@query("key_sets", f"{C}, r AS (SELECT DISTINCT experiment, participant FROM choices WHERE CAST(participant AS INTEGER) % 5 > 0), c AS (SELECT DISTINCT experiment, participant FROM choices WHERE CAST(participant AS INTEGER) % 7 > 0) SELECT experiment, participant, CASE WHEN r.experiment IS NULL THEN 'candidate' WHEN c.experiment IS NULL THEN 'reference' ELSE 'both' END AS side FROM (SELECT *, true AS x FROM r) r FULL JOIN (SELECT *, true AS y FROM c) c USING (experiment, participant)".replace("r.experiment IS NULL", "x IS NULL").replace("c.experiment IS NULL", "y IS NULL"))
def key_sets(spark, sf_dir):
    frame, number = data.choices(spark, sf_dir), F.col("participant").cast("int")
    return integrity.key_sets(frame.where(number % 5 > 0), frame.where(number % 7 > 0))


@query("compare_worst", f"{MATCHED} SELECT experiment, participant, choice_index, round(abs(b - a), 6) AS max_delta FROM m ORDER BY round(abs(b - a), 9) DESC, experiment, participant, choice_index LIMIT 1")
def compare_worst(spark, sf_dir):
    rows = _matched(spark, sf_dir)
    return integrity.worst_row(rows.withColumn("delta", F.round("delta", 9)))


@query("report_gap", f"{MATCHED} SELECT round(abs(avg(g)), 6) AS report_gap FROM (SELECT experiment, avg(b - a) AS g FROM m GROUP BY 1)")
def report_gap(spark, sf_dir):
    return protocol.report_gap(_matched(spark, sf_dir))


@query("published_gaps", f"{C}, o AS (SELECT experiment, avg(m) AS ours FROM (SELECT experiment, participant, avg(nll) AS m FROM choices GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS tasks, round(avg(abs(ours - p)), 6) AS mean_gap, round(max(abs(ours - p)), 6) AS max_gap FROM o JOIN (VALUES ('w0', 2.0), ('w1', 1.0)) AS t(experiment, p) USING (experiment)")
def published_gaps(spark, sf_dir):
    published = spark.createDataFrame([("w0", 2.0), ("w1", 1.0)], "experiment string, task_nll double")
    return protocol.published_gaps(metrics.task_table(data.choices(spark, sf_dir)), published)


@query("index_differences", f"{C} SELECT experiment, participant, choice_index, CASE WHEN event_id % 41 = 0 THEN 'alone' ELSE 'packed' END AS side FROM choices WHERE (event_id % 41 = 0) <> (event_id % 43 = 0)")
def index_differences(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    return protocol.index_differences(frame.where("event_id % 41 <> 0"), frame.where("event_id % 43 <> 0"), CHOICE)


ODD = S + ", odd AS (SELECT experiment, participant, CASE CAST(participant AS INTEGER) % 9 WHEN 1 THEN replace(replace(text, '<<', ''), '>>', '') WHEN 2 THEN text || ' <<>>' ELSE text END AS text FROM sessions)"


def _odd(spark, sf_dir):
    nine, text = F.col("participant").cast("int") % 9, F.col("text")
    bare = F.replace(F.replace(text, F.lit("<<"), F.lit("")), F.lit(">>"), F.lit(""))
    return data.sessions(spark, sf_dir).withColumn("text", F.when(nine == 1, bare).when(nine == 2, F.concat(text, F.lit(" <<>>"))).otherwise(text))


@query("validation_scan", f"{ODD} SELECT experiment, participant, CASE WHEN CAST(participant AS INTEGER) % 9 = 1 THEN 'unmarked' ELSE 'empty_mark' END AS problem FROM odd WHERE CAST(participant AS INTEGER) % 9 IN (1, 2)")
def validation_scan(spark, sf_dir):
    rows = _odd(spark, sf_dir)
    lossy = sampling.lossy_segments(rows).withColumn("problem", F.lit("segments"))
    return sampling.unreadable(rows).unionByName(lossy)


BY_TASK = (
    P
    + ", "
    + data.OPTIONS.split(data.PREDICTIONS, 1)[1].lstrip(",\n ")
    + """, t AS (SELECT experiment, participant, count(*) AS n FROM predictions GROUP BY 1, 2),
h AS (SELECT experiment, participant, human_choice AS code, count(*) / any_value(n) AS share FROM predictions JOIN t USING (experiment, participant) GROUP BY 1, 2, 3),
m AS (SELECT experiment, participant, pred_choice AS code, count(*) / any_value(n) AS share FROM predictions JOIN t USING (experiment, participant) GROUP BY 1, 2, 3),
per AS (SELECT *, exp(logprob) / sum(exp(logprob)) OVER (PARTITION BY experiment, participant, choice_index) AS p FROM options),
tr AS (SELECT experiment, participant, count(DISTINCT choice_index) AS n FROM options GROUP BY 1, 2),
o AS (SELECT experiment, participant, option AS code, sum(p) / any_value(n) AS share FROM per JOIN tr USING (experiment, participant) GROUP BY 1, 2, 3),
a AS (SELECT experiment, participant, sum(abs(coalesce(h.share, 0) - coalesce(m.share, 0))) / 2 AS tvd_pred FROM h FULL JOIN m USING (experiment, participant, code) GROUP BY 1, 2),
ho AS (SELECT * FROM h SEMI JOIN tr USING (experiment, participant)),
b AS (SELECT experiment, participant, sum(abs(coalesce(ho.share, 0) - coalesce(o.share, 0))) / 2 AS tvd_options FROM ho FULL JOIN o USING (experiment, participant, code) GROUP BY 1, 2),
x AS (SELECT experiment, participant, max(share) AS human_top FROM h GROUP BY 1, 2), y AS (SELECT experiment, participant, max(share) AS pred_top FROM m GROUP BY 1, 2), z AS (SELECT experiment, participant, max(share) AS options_top FROM o GROUP BY 1, 2)
SELECT experiment, round(avg(tvd_pred), 6) AS tvd_pred, round(avg(tvd_options), 6) AS tvd_options, round(avg(human_top), 6) AS human_top, round(avg(pred_top), 6) AS pred_top, round(avg(options_top), 6) AS options_top, count(*) AS n_participants, count(tvd_pred) AS n_pred, count(tvd_options) AS n_options
FROM a FULL JOIN b USING (experiment, participant) FULL JOIN x USING (experiment, participant) FULL JOIN y USING (experiment, participant) FULL JOIN z USING (experiment, participant) GROUP BY 1"""
)


@query("distribution_by_task", BY_TASK)
def distribution_by_task(spark, sf_dir):
    rows = data.predictions(spark, sf_dir)
    human, said = readouts.session_frequencies(rows, "human_choice"), readouts.session_frequencies(rows, "pred_choice")
    from pyspark.sql import Window

    p = F.exp("logprob")
    options = data.options(spark, sf_dir).withColumn("share", p / F.sum(p).over(Window.partitionBy(*CHOICE)))
    expected = readouts.session_frequencies(options, "option", "share")
    beside = human.join(expected.select(*SESSION).distinct(), SESSION, "left_semi")
    tables = [
        readouts.total_variation(human, said).withColumnRenamed("tvd", "tvd_pred"), readouts.total_variation(beside, expected).withColumnRenamed("tvd", "tvd_options"),
        readouts.top_share(human, "human_top"), readouts.top_share(said, "pred_top"), readouts.top_share(expected, "options_top"),
    ]
    return readouts.by_task(tables, {"tvd_pred": "n_pred", "tvd_options": "n_options"})


OFF_SQL = f"WITH {data.PREDICTIONS}, so AS (SELECT experiment, participant, list(DISTINCT human_choice) AS o FROM choices GROUP BY 1, 2), w AS (SELECT p.*, trim(raw_generation) AS s, o FROM predictions p JOIN so USING (experiment, participant) WHERE NOT format_ok), c AS (SELECT experiment, participant, choice_index, CASE WHEN num_tokens > 1 THEN 'human_multi_token' WHEN list_contains(o, raw_generation) THEN 'exact' WHEN s <> '' AND list_contains(o, s) THEN 'whitespace_variant' WHEN s <> '' AND list_contains(o, lower(s)) THEN 'case_variant' WHEN s <> '' AND len(list_filter(o, lambda v: starts_with(v, s))) > 0 THEN 'option_prefix' WHEN s = '' THEN 'whitespace_only' WHEN s = '?!' THEN 'punctuation_only' ELSE 'off_task' END AS category FROM w)"


@query("offtask_examples", f"{OFF_SQL} SELECT category, experiment, participant, choice_index FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('0|' || experiment || '|' || participant || '|' || CAST(choice_index AS VARCHAR))) <= 12")
def offtask_examples(spark, sf_dir):
    offered = data.choices(spark, sf_dir).select(*SESSION, F.col("human_choice").alias("option")).distinct()
    return sampling.sample_per_group(readouts.off_task(data.predictions(spark, sf_dir), offered), "category", CHOICE, 12).select("category", *CHOICE)


@query("unaligned_sessions", f"WITH {data.CANONICAL}, l AS (SELECT experiment, participant, count(*) AS n_choices FROM choices GROUP BY 1, 2), r AS (SELECT experiment, participant, count(*) AS n_rows FROM canonical WHERE CAST(participant AS INTEGER) % 11 > 0 GROUP BY 1, 2), al AS (SELECT DISTINCT experiment, participant FROM aligned WHERE CAST(participant AS INTEGER) % 11 > 0) SELECT experiment, participant, n_choices, coalesce(n_rows, 0) AS n_rows, CASE WHEN n_rows IS NULL THEN 'no_table' ELSE 'row_counts' END AS reason FROM l ANTI JOIN al USING (experiment, participant) LEFT JOIN r USING (experiment, participant)")
def unaligned_sessions(spark, sf_dir):
    table = data.canonical(spark, sf_dir).where(F.col("participant").cast("int") % 11 > 0)
    return canonical.unaligned_sessions(data.choices(spark, sf_dir), table)


@query("canonical_codes_written", "WITH v AS (SELECT o_orderkey, list_extract(['1d', '2F', '3d', '1e20', '1_0', '+5', '.5', '-1.5'], CAST(o_orderkey % 8 + 1 AS INTEGER)) AS value FROM orders) SELECT o_orderkey, CASE value WHEN '1e20' THEN '100000000000000000000' WHEN '1_0' THEN '10' WHEN '+5' THEN '5' WHEN '-1.5' THEN NULL ELSE value END AS code FROM v")
def canonical_codes_written(spark, sf_dir):
    values = F.array(*map(F.lit, ("1d", "2F", "3d", "1e20", "1_0", "+5", ".5", "-1.5")))
    return data.read(spark, sf_dir, "orders").select("o_orderkey", canonical_code(F.get(values, (F.col("o_orderkey") % 8).cast("int"))).alias("code"))


@query("experiment_names", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'first' ELSE p_brand END || '/' || p_type AS folder, p_brand || ' e' || p_type AS short FROM part")
def experiment_names(spark, sf_dir):
    part = data.read(spark, sf_dir, "part")
    return part.select("p_partkey", table_folder(F.concat("p_brand", F.lit("/"), "p_type", F.lit(".csv")), {"first": "Brand#11"}).alias("folder"), short_name(F.concat("p_brand", F.lit("/exp"), "p_type", F.lit(".csv"))).alias("short"))


@query("repair_names", "SELECT c_custkey, replace(replace(c_mktsegment, 'BUILD', 'Ä'), 'ING', 'ö') AS experiment FROM customer")
def repair_names(spark, sf_dir):
    rows = data.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("experiment"))
    return readers.repair_names(rows, {"BUILD": "Ä", "ING": "ö"})


@query("all_supervised_labels", f"{TOKENS}, l AS (SELECT *, CASE WHEN b > a AND EXISTS (SELECT 1 FROM (SELECT unnest(range(0, t.n)) AS k) WHERE a < k * 12 + 10 AND b > k * 12 + 4) THEN id ELSE -100 END AS label FROM t) SELECT experiment, participant, CAST(sum(label) AS BIGINT) AS total, count(*) FILTER (WHERE label <> -100) AS learned, bool_or(label <> -100) AS has FROM l GROUP BY 1, 2")
def all_supervised_labels(spark, sf_dir):
    from ..functions import supervision as sv

    rows = _tokens(spark, sf_dir)
    labels = rows.select(*SESSION, sv.supervised_labels(F.col("ids"), sv.tokens_of_spans(F.col("tokens"), F.col("spans"))).alias("l"))
    each = labels.select(*SESSION, sv.has_supervision(F.col("l")).alias("has"), F.explode("l").alias("label"))
    return each.groupBy(*SESSION).agg(F.sum("label").alias("total"), F.count_if(F.col("label") != sv.IGNORE).alias("learned"), F.bool_or("has").alias("has"))


@query("train_eval_split", f"{C}, s AS (SELECT experiment, count(DISTINCT participant) AS n FROM choices GROUP BY 1) SELECT experiment, n, true AS whole, true AS apart FROM s")
def train_eval_split(spark, sf_dir):
    """The two parts hold every session once: nothing is lost, nothing is in both."""
    rows = data.choices(spark, sf_dir).select(*SESSION).distinct()
    train, test = sampling.split_train_eval(rows, SESSION, 0.3, 5)
    both = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)))
    return both.groupBy("experiment").agg(F.countDistinct("participant").alias("n"), F.lit(True).alias("whole"), (F.count("*") == F.countDistinct("participant")).alias("apart"))


WINDOW_GRID = C + ", n AS (SELECT experiment, participant, count(*) AS n FROM choices GROUP BY 1, 2), e AS (SELECT *, n - 1 AS l FROM n), c AS (SELECT *, least(greatest(CAST(round_even(0.1 * l, 0) AS BIGINT), 2), n - 3) AS a FROM e WHERE n > 5), d AS (SELECT *, least(greatest(CAST(round_even(0.5 * l, 0) AS BIGINT), a + 1), n - 2) AS b FROM c), t AS (SELECT experiment, participant, n, unnest([0, 1, a, b, l]) AS t FROM d UNION ALL SELECT experiment, participant, n, unnest(range(0, n)) FROM n WHERE n <= 5), f AS (SELECT experiment, participant, n, unnest(range(0, n)) AS t FROM n)"


@query("window_grid", f"{WINDOW_GRID}, r AS (SELECT experiment, participant, 'w' || CAST(w AS VARCHAR) AS condition, t, least(w, t) AS e, true AS anchor, n FROM t, (VALUES (0), (1), (2), (5)) AS v(w) UNION ALL SELECT f.experiment, f.participant, 'full', f.t, f.t, t.t IS NOT NULL, f.n FROM f LEFT JOIN t ON f.experiment = t.experiment AND f.participant = t.participant AND f.t = t.t) SELECT experiment, condition, count(*) AS requests, count(*) FILTER (WHERE anchor) AS anchors, CAST(sum(e) AS BIGINT) AS effective, round(sum(t / greatest(n - 1, 1)), 6) AS fractions FROM r GROUP BY 1, 2")
def window_grid(spark, sf_dir):
    """Anchors come from the grid over each session's own length."""
    lengths = data.choices(spark, sf_dir).groupBy(*SESSION).agg(F.count("*").cast("int").alias("n_segments"))
    rows = protocol.window_grid(lengths, [0, 1, 2, 5], tx.anchor_targets(F.col("n_segments")))
    return rows.groupBy("experiment", "condition").agg(F.count("*").alias("requests"), F.count_if("is_anchor").alias("anchors"), F.sum("effective_window").cast("long").alias("effective"), F.sum("target_fraction").alias("fractions"))


@query("window_grid_rules", "SELECT 'none' AS experiment, 'none' AS participant, 'none' AS rule, CAST(0 AS BIGINT) AS n WHERE false")
def window_grid_rules(spark, sf_dir):
    """The grid's own rows break none of the rules that a run's rows are held to."""
    lengths = data.choices(spark, sf_dir, dealt=True).groupBy(*SESSION).agg(F.count("*").cast("int").alias("n_segments"))
    return protocol.window_violations(protocol.window_grid(lengths, [0, 1, 2, 5], tx.anchor_targets(F.col("n_segments"))), [0, 1, 2, 5])


@query("session_conditions", f"{C} SELECT experiment, participant, CASE CAST(participant AS INTEGER) % 10 WHEN 1 THEN 'conditions' ELSE 'counts' END AS rule FROM (SELECT DISTINCT experiment, participant FROM choices) WHERE CAST(participant AS INTEGER) % 10 IN (1, 2)")
def session_conditions(spark, sf_dir):
    from ..sources.writers import receipts

    rows = data.choices(spark, sf_dir).withColumn("condition", F.lit("full"))
    tens = F.col("participant").cast("int") % 10
    wrong = F.when(tens == 1, F.map_concat("conditions", F.create_map(F.lit("extra"), F.lit(2).cast("long")))).when(tens == 2, F.transform_values("conditions", lambda k, v: v + 1)).otherwise(F.col("conditions"))
    return protocol.session_conditions(rows, receipts(rows).withColumn("conditions", wrong))


@query("shaped_scores", f"WITH {data.OPTIONS} SELECT 'm' AS model, experiment, participant, choice_index, option, round(logprob, 6) AS logprob FROM options")
def shaped_scores(spark, sf_dir):
    nested = data.options(spark, sf_dir).groupBy(*CHOICE).agg(F.collect_list(F.struct("option", "logprob")).alias("options"))
    return shape_scores(nested, {"model": "m"})["pred_options"]


@query("latest_step", "SELECT 'run/checkpoint-' || CAST(max(o_orderkey) AS VARCHAR) AS path, CAST(max(o_orderkey) AS BIGINT) AS step FROM orders")
def latest_step(spark, sf_dir):
    orders = data.read(spark, sf_dir, "orders")
    paths = orders.select(F.concat(F.lit("run/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path"))
    return protocol.latest_step(paths.unionByName(paths.select(F.concat("path", F.lit("-old")).alias("path"))))


@query("merge_run_report", f"{SHARDS}, k AS (SELECT count(*) AS n, CAST(sum(num_tokens * 2) AS BIGINT) AS whole FROM choices), again AS (SELECT count(*) AS n FROM choices WHERE event_id % 9 = 0), cut AS (SELECT CAST(sum(num_tokens * 2 - 1) AS BIGINT) AS lost, CAST(sum(num_tokens * 2) AS BIGINT) AS full_rows FROM choices WHERE event_id % 17 = 0) SELECT 'predictions' AS \"table\", k.n AS rows, again.n AS replays, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS orphans FROM k, again UNION ALL SELECT 'pred_topk', whole, whole - full_rows, lost, CAST((SELECT count(*) FROM choices) AS BIGINT) FROM k, cut")
def merge_run_report(spark, sf_dir):
    """Predictions with replays, and their rows of likely tokens: cut short at first here and there, whole again later, and one without a parent each."""
    place = lambda f, add: f.withColumn("shard", F.col("participant").cast("int") % 4).withColumn("row_idx", F.col("event_id") * 8 + F.col("token_index") * 2 + F.col("rank") + add)
    names = [*CHOICE, "token_index", "rank", "event_id"]
    first = _children(spark, sf_dir).select(*names)
    whole = data.choices(spark, sf_dir).select(*CHOICE, "event_id", F.explode(F.sequence(F.lit(0), F.col("num_tokens") * 2 - 1)).alias("k"))
    whole = whole.select(*CHOICE, F.floor(F.col("k") / 2).alias("token_index"), (F.col("k") % 2).alias("rank"), "event_id")
    lost = data.choices(spark, sf_dir).select("experiment", F.concat(F.lit("9"), F.lpad("participant", 8, "0")).alias("participant"), "choice_index", F.lit(0).cast("long").alias("token_index"), F.lit(0).alias("rank"), "event_id")
    rows = place(first, 0).unionByName(place(whole, 1_000_000_000_000)).unionByName(place(lost, 2_000_000_000_000)).drop("event_id")
    kinds = {"pred_topk": merge.Child(["token_index", "rank"], "num_tokens * 2")}
    return merge.merged_tables(_shards(spark, sf_dir), {"pred_topk": rows}, kinds)[1]


#: The model that stands for one here: labels in pieces, other characters by their code; token j behind `n` tokens has the logit (n * (j + 1)) % 7.
VOCABULARY = 16
PIECES = ["click", "error", "pur", "chase", "signup", "view", "ok"]


def toy_model(names=PIECES):
    pieces = re.compile("|".join([*names, "(?s:.)"]))
    numbers = {chr(c): 7 + c % 9 for c in range(128)} | {n: k for k, n in enumerate(names)}

    def encode(text):
        found = pieces.findall(text)  # every character is in one of them, so places are sums of lengths
        ends = np.fromiter(map(len, found), np.int64, len(found)).cumsum()
        ids = np.array([numbers[x] if x in numbers else 7 + ord(x) % 9 for x in found], np.int64)
        return np.array([ids, np.concatenate([[0], ends[:-1]]) if found else ends, ends], np.int64).T

    def logits(requests):
        return [(np.array(places)[:, None] * (np.arange(VOCABULARY)[None, :] + 1) % 7).astype(float) for _, places in requests]

    return scoring.Model(encode, lambda k: names[k] if k < len(names) else chr(90 + k), logits)


TOKEN_SQL = "'click|error|pur|chase|signup|view|ok|(?s:.)'"
SCORED_SQL = (
    S
    + f""", cut AS (SELECT experiment, participant, regexp_extract(text, '^(.*Rules\\.\\n\\n)', 1, 's') AS header, regexp_extract_all(text, 'Trial [^\\n]*\\n') AS segments, list_sort(list_distinct(regexp_extract_all(text, '<<(.*?)>>', 1))) AS support FROM sessions),
n AS (SELECT *, len(segments) AS n, len(segments) - 1 AS l, len(regexp_extract_all(header, {TOKEN_SQL})) AS head, list_transform(segments, lambda v: len(regexp_extract_all(v, {TOKEN_SQL}))) AS sizes, list_transform(segments, lambda v: len(regexp_extract_all(v, '<<'))) AS marks FROM cut),
c AS (SELECT *, least(greatest(CAST(round_even(0.1 * l, 0) AS BIGINT), 2), n - 3) AS a FROM n WHERE n > 5),
d AS (SELECT *, least(greatest(CAST(round_even(0.5 * l, 0) AS BIGINT), a + 1), n - 2) AS b FROM c),
t AS (SELECT experiment, participant, unnest([0, 1, a, b, l]) AS t FROM d UNION ALL SELECT experiment, participant, unnest(range(0, n)) FROM n WHERE n <= 5),
r AS (SELECT experiment, participant, t, 'w' || CAST(w AS VARCHAR) AS condition, w, least(w, t) AS e FROM t, (VALUES (0), (1), (3)) AS v(w) UNION ALL SELECT experiment, participant, t, 'full', NULL, t FROM (SELECT experiment, participant, unnest(range(0, n)) AS t FROM n)),
q AS (SELECT r.*, support, head + coalesce(list_sum(sizes[t - e + 1:t]), 0) AS before, coalesce(list_sum(marks[1:t]), 0) AS first, string_split(segments[t + 1], '<<') AS parts FROM r JOIN n USING (experiment, participant)),
k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM q),
z AS (SELECT *, first + k - 1 AS choice_index, split_part(parts[k + 1], '>>', 1) AS human_choice, before + len(regexp_extract_all(array_to_string(parts[1:k], '<<') || '<<', {TOKEN_SQL})) AS start FROM k),
y AS (SELECT *, regexp_extract_all(human_choice, {TOKEN_SQL}) AS toks FROM z),
x AS (SELECT *, unnest(range(0, len(toks))) AS i, unnest(toks) AS tok FROM y),
p AS (SELECT *, list_transform(range(0, 16), lambda j: ((start + i) * (j + 1)) % 7) AS logits, coalesce(list_position({PIECES}, tok) - 1, 7 + ascii(tok) % 9) AS id FROM x),
lp AS (SELECT *, list_transform(logits, lambda v: v - ln(list_sum(list_transform(logits, lambda u: exp(u))))) AS lp FROM p),
said AS (SELECT *, list_position(lp, list_max(lp)) - 1 AS best, CASE WHEN len(support) > 5 THEN 'too_many_options' WHEN list_contains(support, 'purchase') THEN 'multi_token_option' ELSE 'scored' END AS status FROM lp)"""
)
SCORE_KEYS = "experiment, participant, condition, CAST(w AS INTEGER) AS window_size, CAST(t AS INTEGER) AS target_index, CAST(e AS INTEGER) AS effective_window, CAST(choice_index AS INTEGER) AS choice_index"
PIECE_SQL = f"coalesce(list_extract({PIECES}, CAST(best + 1 AS INTEGER)), chr(CAST(90 + best AS INTEGER)))"
SCORES = f"""{SCORED_SQL}, one AS (SELECT *, {PIECE_SQL} AS pred_choice, CASE WHEN status = 'scored' THEN list_sum(list_transform(support, lambda o: exp(lp[list_position({PIECES}, o)]))) END AS mass, -list_sum(list_transform(lp, lambda v: exp(v) * v)) AS h FROM said WHERE i = 0),
total AS (SELECT experiment, participant, condition, choice_index, round(-sum(lp[id + 1]), 6) AS nll FROM said GROUP BY 1, 2, 3, 4)
SELECT {SCORE_KEYS}, human_choice, nll, CAST(len(toks) AS INTEGER) AS num_tokens, CAST(best AS INTEGER) AS pred_token_id, pred_choice, list_contains(support, pred_choice) AS format_ok,
  CAST(len(support) AS INTEGER) AS k_options, round(h, 6) AS entropy, round(mass, 6) AS legal_mass, status AS options_status FROM one JOIN total USING (experiment, participant, condition, choice_index)"""
TOPK = f"""{SCORED_SQL}, each_one AS (SELECT *, unnest(range(0, 16)) AS best, unnest(lp) AS v FROM (SELECT * EXCLUDE (best) FROM said)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment, participant, condition, choice_index, i ORDER BY round(v, 9) DESC, best) - 1 AS rank FROM each_one)
SELECT {SCORE_KEYS}, CAST(i AS INTEGER) AS token_index, CAST(rank AS INTEGER) AS rank, CAST(best AS INTEGER) AS token_id, {PIECE_SQL} AS token, round(v, 6) AS logprob FROM ranked WHERE rank < 3"""
SCORED_OPTIONS = f"""{SCORED_SQL}, o AS (SELECT *, unnest(support) AS option FROM said WHERE i = 0 AND status = 'scored')
SELECT {SCORE_KEYS}, option, round(lp[list_position({PIECES}, option)], 6) AS logprob, CAST(1 AS INTEGER) AS n_tokens, option = human_choice AS is_human FROM o"""


def _dealt(spark, sf_dir):
    """Sessions in as many partitions as shuffles have: a model's work is far larger than its input, by whose size Spark would deal it."""
    # by a hash of the session: Spark drops a repartition by the very columns that rows are dealt by, and joins small partitions of the former
    return data.sessions(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*SESSION))


def _scores(spark, sf_dir, top_k=0):
    """Every choice of the target segments under three windows at the anchors, and every choice of the whole transcripts, from one pass; top tokens where they are asked for."""
    cells = scoring.window_cells(_dealt(spark, sf_dir), [0, 1, 3, "full"], tx.anchor_targets)
    scored = scoring.choice_scores(scoring.score(scoring.prepare(cells, toy_model, max_options=5), toy_model, top_k=top_k))
    return shape_scores(scored, {}, [*SESSION, *scoring.SCORED])


@query("resumed_run", f"WITH t AS ({SCORES}) SELECT experiment, condition, count(DISTINCT participant) AS sessions, count(*) AS n_choices, round(sum(nll), 6) AS nll FROM t GROUP BY 1, 2")
def resumed_run(spark, sf_dir):
    """A run that ends after one wave and is resumed: what its receipts vouch for is the whole."""
    path = work_folder(spark)
    keys = [*SESSION, *scoring.SCORED]

    def nested(rows):
        cells = scoring.window_cells(rows, [0, 1, 3, "full"], tx.anchor_targets)
        return scoring.choice_scores(scoring.score(scoring.prepare(cells, toy_model, max_options=5), toy_model, top_k=3))

    sessions = written(_dealt(spark, sf_dir))
    runs.score_run(sessions, path, nested, keys, waves=3, most_waves=1)
    runs.score_run(sessions, path, nested, keys, waves=3, resume=True)
    rows = runs.finished(spark, path, "predictions")
    return rows.groupBy("experiment", "condition").agg(F.countDistinct("participant").alias("sessions"), F.count("*").alias("n_choices"), F.sum(F.round("nll", 6)).alias("nll"))


def _sized(table):
    return table.withColumnRenamed("window", "window_size")


@query("transcript_scores", SCORES)
def transcript_scores(spark, sf_dir):
    return _sized(_scores(spark, sf_dir)["predictions"]).drop("raw_generation", "top_logprob")


@query("transcript_topk", TOPK)
def transcript_topk(spark, sf_dir):
    return _sized(_scores(spark, sf_dir, top_k=3)["pred_topk"])


@query("transcript_options", SCORED_OPTIONS)
def transcript_options(spark, sf_dir):
    return _sized(_scores(spark, sf_dir)["pred_options"])


@query("exact_quantiles", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 6) AS quantile, count(*) AS n FROM lineitem GROUP BY 1, 2")
def exact_quantiles(spark, sf_dir):
    """Groups with more distinct values than are looked through at once."""
    return exact_quantile(data.read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9)


@query("shard_mod_scan", f"{ROWS} SELECT row_idx, experiment, participant FROM rows WHERE row_idx % 4 = 1")
def shard_mod_scan(spark, sf_dir):
    """A shard of sessions by their line numbers, which the scan of the JSON lines gives."""
    name = work_folder(spark)
    rows = data.sessions(spark, sf_dir).orderBy("experiment", F.col("participant").cast("int"))
    rows.write.json(name)
    return sampling.modulo_shard(readers.read_sessions(spark, name), 1, 4).select("row_idx", *SESSION)


#: Whole labels are tokens, so that no cutoff splits one.
LABEL_TOKENS = ["click", "error", "purchase", "signup", "view", "ok"]
LABEL_SQL = "'click|error|purchase|signup|view|ok|(?s:.)'"


@query("paper_selection", f"{S}, x AS (SELECT experiment, participant, string_split(text, '<<') AS parts FROM sessions), k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM x), f AS (SELECT experiment, participant, k - 1 AS choice_index, len(regexp_extract_all(array_to_string(parts[1:k], '<<') || '<<', {LABEL_SQL})) AS first FROM k) SELECT experiment, participant, CAST(choice_index AS INTEGER) AS choice_index, CAST(first AS INTEGER) AS first_token, CAST(1 AS INTEGER) AS num_tokens FROM f WHERE first + 1 <= 150")
def paper_selection(spark, sf_dir):
    """The choices of a protocol that cuts transcripts at a number of tokens."""
    return protocol.within_cutoff(scoring.choice_tokens(_dealt(spark, sf_dir), lambda: toy_model(LABEL_TOKENS)), 150)


BATCHES = f"""{S}, x AS (SELECT experiment, participant, regexp_split_to_array(text, '<<|>>') AS pieces FROM sessions), e AS (SELECT experiment, participant, unnest(range(1, len(pieces) + 1)) AS p, unnest(pieces) AS piece FROM x),
n AS (SELECT *, len(regexp_extract_all(piece, {TOKEN_SQL})) AS n FROM e), a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY experiment, participant ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 * (p - 1) AS start FROM n),
t AS (SELECT experiment, participant, least(max(start + n), 200) AS tokens, CAST(coalesce(sum(greatest(least(200, start + n) - start, 0)) FILTER (WHERE p % 2 = 0), 0) AS BIGINT) AS learned FROM a GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY experiment ORDER BY CAST(participant AS INTEGER)) - 1) // 8 AS batch FROM t WHERE learned > 0)
SELECT experiment, batch, count(*) AS rows, CAST(max(tokens) AS INTEGER) AS width, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(learned) AS BIGINT) AS learned, CAST(count(*) * max(tokens) - sum(tokens) AS BIGINT) AS padded FROM r GROUP BY 1, 2"""


@query("supervised_batches", BATCHES)
def supervised_batches(spark, sf_dir):
    """Batches of eight sessions of a task in the order of their participants, each padded to its own longest."""
    rows, _ = training_set.supervised_set(data.sessions(spark, sf_dir), toy_model, 200)
    rows = rows.repartition("experiment").sortWithinPartitions("experiment", F.col("participant").cast("int"))
    made = training_set.padded_batches(rows, 8, -1, ["experiment"])
    first = F.min("batch").over(Window.partitionBy("experiment"))
    made = made.withColumn("batch", F.col("batch") - first)  # numbers run through a partition's tasks
    count = lambda c, f: F.sum(F.size(F.filter(c, f))).cast("long")
    return made.groupBy("experiment", "batch").agg(
        F.count("*").alias("rows"), F.max("width").alias("width"), count("attention", lambda x: x == 1).alias("tokens"), count("labels", lambda x: x != sv.IGNORE).alias("learned"), count("ids", lambda x: x == -1).alias("padded")
    )
