"""Supervision arrays, cutoffs, acceptance and protocol checks over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import supervision as sv
from ..operators import metrics, protocol
from ..schemas import CHOICE, SESSION
from ..sources import testdata as data
from .registry import query

C, W, P = f"WITH {data.CHOICES}", f"WITH {data.WINDOWS}", f"WITH {data.PREDICTIONS}"


def _tokens(spark, sf_dir):
    """Sessions as arrays: ids, token places of three characters, and spans."""
    rows = data.choices(spark, sf_dir).groupBy(*SESSION).agg(F.count("*").cast("int").alias("n"))
    ids = F.transform(F.sequence(F.lit(0), F.col("n") * 4 - 1), lambda i: (i * 7 % 50).cast("int"))
    tokens = F.transform(F.sequence(F.lit(0), F.col("n") * 4 - 1), lambda i: F.struct((i * 3).alias("start"), (i * 3 + F.when(i % 4 == 3, 0).otherwise(3)).alias("end")))
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((i * 12 + 4).alias("start"), (i * 12 + 10).alias("end")))
    return rows.select(*SESSION, "n", ids.alias("ids"), tokens.alias("tokens"), spans.alias("spans"))


TOKENS = C + ", s AS (SELECT experiment, participant, CAST(count(*) AS INTEGER) AS n FROM choices GROUP BY 1, 2), t AS (SELECT experiment, participant, n, CAST(i AS INTEGER) AS i, CAST(i * 7 % 50 AS INTEGER) AS id, i * 3 AS a, i * 3 + CASE WHEN i % 4 = 3 THEN 0 ELSE 3 END AS b FROM s, range(0, 2000) AS r(i) WHERE i < n * 4)"


@query("span_tokens", f"{TOKENS} SELECT experiment, participant, count(*) AS pairs, CAST(sum(i) AS BIGINT) AS places FROM t JOIN range(0, 500) AS q(k) ON k < n AND b > a AND a < k * 12 + 10 AND b > k * 12 + 4 GROUP BY 1, 2")
def span_tokens(spark, sf_dir):
    each = _tokens(spark, sf_dir).select(*SESSION, F.explode(F.flatten(sv.tokens_of_spans(F.col("tokens"), F.col("spans")))).alias("i"))
    return each.groupBy(*SESSION).agg(F.count("*").alias("pairs"), F.sum("i").alias("places"))


@query("supervised_labels", f"{TOKENS}, l AS (SELECT *, CASE WHEN b > a AND EXISTS (SELECT 1 FROM range(0, 500) AS q(k) WHERE k < n AND a < k * 12 + 10 AND b > k * 12 + 4) THEN id ELSE -100 END AS label FROM t) SELECT experiment, participant, CAST(sum(label) AS BIGINT) AS total, count(*) FILTER (WHERE label <> -100) AS learned FROM l WHERE i < 10 GROUP BY 1, 2")
def supervised_labels(spark, sf_dir):
    labels = sv.supervised_labels(F.col("ids"), sv.tokens_of_spans(F.col("tokens"), F.col("spans")))
    rows = _tokens(spark, sf_dir).select(*SESSION, F.explode(sv.truncated(labels, 10)).alias("label"))
    return rows.groupBy(*SESSION).agg(F.sum("label").alias("total"), F.count_if(F.col("label") != sv.IGNORE).alias("learned"))


@query("padded_batch", f"{TOKENS}, w AS (SELECT experiment, max(n) * 4 AS width FROM s GROUP BY 1) SELECT s.experiment, participant, CAST(width AS INTEGER) AS width, CAST(width - 4 * n AS INTEGER) AS filled FROM s JOIN w USING (experiment)")
def padded_batch(spark, sf_dir):
    rows = _tokens(spark, sf_dir).withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("experiment")))
    full = sv.padded(F.col("ids"), F.col("width"), -1)
    return rows.select("experiment", "participant", F.size(full).alias("width"), F.size(F.filter(full, lambda x: x == -1)).alias("filled"))


@query("truncated_tail", f"{TOKENS} SELECT experiment, participant, CAST(sum(id) AS BIGINT) AS total, count(*) AS kept FROM t WHERE i >= 4 * n - 9 GROUP BY 1, 2")
def truncated_tail(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select(*SESSION, F.explode(sv.truncated(F.col("ids"), 9, "tail")).alias("id"))
    return rows.groupBy(*SESSION).agg(F.sum("id").alias("total"), F.count("*").alias("kept"))


@query("marked_record", "SELECT o_orderkey, 'trial={\"o_custkey\":' || CAST(o_custkey AS VARCHAR) || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}' || chr(10) || 'target=<<{\"o_orderstatus\":\"' || o_orderstatus || '\"}>>' || chr(10) AS text FROM orders")
def marked_record(spark, sf_dir):
    return data.read(spark, sf_dir, "orders").select("o_orderkey", sv.marked_record(["o_custkey", "o_orderpriority"], ["o_orderstatus"]).alias("text"))


CUT = C + ", f AS (SELECT *, 2 * choice_index AS first_token FROM choices)"


@query("paper_selection", f"{CUT} SELECT experiment, count(*) AS n, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM f WHERE first_token + num_tokens <= 20 GROUP BY 1")
def paper_selection(spark, sf_dir):
    rows = data.choices(spark, sf_dir).withColumn("first_token", F.col("choice_index") * 2)
    kept = protocol.within_cutoff(rows, 20)
    return protocol.expected_scores(rows.drop("first_token"), kept).groupBy("experiment").agg(F.count("*").alias("n"), F.sum("num_tokens").alias("tokens"))


@query("against_published", f"{C}, o AS (SELECT experiment, avg(m) AS ours FROM (SELECT experiment, participant, avg(nll) AS m FROM choices GROUP BY 1, 2) GROUP BY 1) SELECT experiment, round(ours, 6) AS ours, CAST(CASE experiment WHEN 'w0' THEN 2.0 WHEN 'w9' THEN 1.0 END AS DOUBLE) AS published, round(abs(ours - CASE experiment WHEN 'w0' THEN 2.0 END), 6) AS gap FROM (SELECT * FROM o UNION ALL SELECT 'w9', NULL)")
def against_published(spark, sf_dir):
    published = spark.createDataFrame([("w0", 2.0), ("w9", 1.0)], "experiment string, task_nll double")
    return protocol.against_published(metrics.task_table(data.choices(spark, sf_dir)), published)


@query("floor_statistics", f"{C}, d AS (SELECT experiment, nll * (event_id % 7 - 3) / 100.0 AS delta FROM choices), t AS (SELECT experiment, abs(avg(delta)) AS gap FROM d GROUP BY 1) SELECT (SELECT round(avg(abs(delta)), 6) FROM d) AS row_mae, (SELECT round(max(abs(delta)), 6) FROM d) AS row_max, round(avg(gap), 6) AS task_mae, round(quantile_cont(CAST(gap AS DOUBLE), CAST(0.95 AS DOUBLE)), 6) AS task_p95, round(max(gap), 6) AS task_max FROM t")
def floor_statistics(spark, sf_dir):
    rows = data.choices(spark, sf_dir).withColumn("delta", F.col("nll") * (F.col("event_id") % 7 - 3) / 100.0)
    return protocol.floor_statistics(rows)


@query("window_violations", f"{W}, n AS (SELECT experiment, participant, count(*) AS n FROM big GROUP BY 1, 2) SELECT experiment, participant, 'effective_window' AS rule, count(*) AS n FROM windows JOIN n USING (experiment, participant) WHERE window_size = 2 AND choice_index % 5 = 0 GROUP BY 1, 2")
def window_violations(spark, sf_dir):
    """Sessions under windows, with a wrong effective window here and there."""
    big = data.big_choices(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy(*SESSION))
    full = big.select(*SESSION, "choice_index", F.lit(None).cast("int").alias("window"), F.col("choice_index").alias("target_index"), F.col("choice_index").alias("effective_window"), n.alias("n_segments"))
    limited = data.windows(spark, sf_dir).select(*SESSION, "choice_index", "window", "target_index", "effective_window")
    wrong = (F.col("window") == 2) & (F.col("choice_index") % 5 == 0)
    limited = limited.withColumn("effective_window", F.col("effective_window") + F.when(wrong, 1).otherwise(0))
    limited = limited.join(big.groupBy(*SESSION).agg(F.count("*").alias("n_segments")), SESSION)
    rows = full.unionByName(limited).withColumn("is_anchor", data.is_anchor(F.col("choice_index"), F.col("n_segments")))
    rows = rows.withColumn("target_fraction", F.col("target_index") / F.greatest(F.col("n_segments") - 1, F.lit(1)))
    return protocol.window_violations(rows, [0, 1, 2, 5])


@query("option_violations", f"WITH {data.OPTIONS} SELECT experiment, participant, choice_index, CASE WHEN event_id % 19 = 0 THEN 'several_tokens' WHEN event_id % 23 = 0 THEN 'logprob' ELSE 'human_option' END AS rule FROM predictions WHERE options_status = 'scored' AND (event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0)")
def option_violations(spark, sf_dir):
    rows = data.predictions(spark, sf_dir)
    e = F.col("event_id")
    options = data.options(spark, sf_dir).join(rows.select(*CHOICE, "event_id", "human_choice"), CHOICE)
    options = options.withColumn("is_human", (F.col("option") == F.col("human_choice")) & (e % 29 != 0)).withColumn("n_tokens", F.when(e % 19 == 0, 2).otherwise(1))
    options = options.withColumn("logprob", F.when(e % 23 == 0, 0.5).otherwise(F.col("logprob")))
    return protocol.option_violations(options, rows)


@query("acceptance", f"{C} SELECT experiment, participant, CASE WHEN CAST(participant AS INTEGER) % 9 = 0 THEN 'full,w0' ELSE 'w0' END AS missing FROM choices GROUP BY 1, 2 HAVING CAST(participant AS INTEGER) % 9 = 0 OR max(choice_index) < 3")
def acceptance(spark, sf_dir):
    rows = data.choices(spark, sf_dir)
    done = rows.where(F.col("participant").cast("int") % 9 != 0)
    both = done.withColumn("condition", F.lit("full")).unionByName(done.where("choice_index >= 3").withColumn("condition", F.lit("w0")))
    return protocol.acceptance(both, rows, ["full", "w0"])


@query("packed_against_alone", f"{C} SELECT CASE WHEN choice_index % 2 = 0 THEN 'full' ELSE 'w0' END AS condition, count(*) AS rows, round(max(abs(nll * 0.01)) FILTER (WHERE event_id % 31 <> 0), 6) AS max_gap, round(avg(abs(nll * 0.01)) FILTER (WHERE event_id % 31 <> 0), 6) AS mean_gap, count(*) FILTER (WHERE event_id % 31 = 0) AS nan_mismatches FROM choices GROUP BY 1")
def packed_against_alone(spark, sf_dir):
    rows = data.choices(spark, sf_dir).withColumn("condition", F.when(F.col("choice_index") % 2 == 0, "full").otherwise("w0"))
    packed = rows.withColumn("nll", F.when(F.col("event_id") % 31 == 0, float("nan")).otherwise(F.col("nll") * 1.01))
    return protocol.packed_against_alone(packed, rows)


@query("length_batches", f"{C}, s AS (SELECT experiment, participant, count(*) AS n FROM choices GROUP BY 1, 2) SELECT experiment, participant, n, row_number() OVER (PARTITION BY experiment ORDER BY n DESC, participant) - 1 AS place, greatest(1, 64 // n) AS fits FROM s")
def length_batches(spark, sf_dir):
    rows = data.choices(spark, sf_dir).groupBy(*SESSION).agg(F.count("*").alias("n"))
    return protocol.batch_numbers(rows, "experiment", "n", "participant", 64)


@query("position_gaps", f"{W}, x AS (SELECT window_size, choice_index // 20 AS bucket, experiment, participant, avg(nll) AS m FROM windows GROUP BY 1, 2, 3, 4) SELECT window_size, bucket, round(avg(t), 6) AS nll FROM (SELECT window_size, bucket, experiment, avg(m) AS t FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2")
def position_gaps(spark, sf_dir):
    rows = data.windows(spark, sf_dir).withColumn("bucket", F.floor(F.col("choice_index") / 20))
    table = metrics.task_table(rows, by=("window", "bucket", "experiment"))
    return table.groupBy(F.col("window").alias("window_size"), "bucket").agg(F.avg("task_nll").alias("nll"))


