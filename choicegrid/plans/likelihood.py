"""Likelihood tables, baselines and comparisons of runs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, curves, integrity, metrics
from ..schemas import CHOICE, SESSION
from ..sources import testdata as data
from .registry import query

C, B, W = f"WITH {data.CHOICES}", f"WITH {data.BIG_CHOICES}", f"WITH {data.WINDOWS}"
PER = "SELECT experiment, participant, avg(nll) AS m, count(*) AS n FROM {t} GROUP BY 1, 2"
TASKS = "SELECT experiment, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices, round(avg(m), 6) AS task_nll, round(exp(-avg(m)), 6) AS task_probability FROM ({}) GROUP BY 1"


@query("task_table", f"{C} {TASKS.format(PER.format(t='choices'))}")
def task_table(spark, sf_dir):
    return metrics.task_table(data.choices(spark, sf_dir))


@query("task_table_big", f"{B} {TASKS.format(PER.format(t='big'))}")
def task_table_big(spark, sf_dir):
    return metrics.task_table(data.big_choices(spark, sf_dir))


@query("task_probability", f"{C} SELECT experiment, round(exp(-avg(m)), 6) AS task_probability FROM ({PER.format(t='choices')}) GROUP BY 1")
def task_probability(spark, sf_dir):
    return metrics.task_table(data.choices(spark, sf_dir)).select("experiment", "task_probability")


ONLINE = (
    C
    + """, lagged AS (
  SELECT *, lag(human_choice) OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS prev FROM choices),
sizes AS (SELECT experiment, participant, count(DISTINCT human_choice) AS k FROM choices GROUP BY 1, 2),
counted AS (
  SELECT l.*, k,
    (SELECT count(*) FROM choices c WHERE c.experiment = l.experiment AND c.participant = l.participant AND c.choice_index < l.choice_index AND c.human_choice = l.human_choice) AS u,
    (SELECT count(*) FROM lagged c WHERE c.experiment = l.experiment AND c.participant = l.participant AND c.choice_index < l.choice_index AND c.prev = l.prev AND c.human_choice = l.human_choice) AS b,
    (SELECT count(*) FROM lagged c WHERE c.experiment = l.experiment AND c.participant = l.participant AND c.choice_index < l.choice_index AND c.prev = l.prev) AS p,
    (SELECT count(*) FROM lagged c WHERE c.experiment = l.experiment AND c.participant = l.participant AND c.choice_index < l.choice_index AND c.prev IS NOT NULL) AS t,
    (SELECT count(*) FROM lagged c WHERE c.experiment = l.experiment AND c.participant = l.participant AND c.choice_index < l.choice_index AND c.prev = c.human_choice) AS r
  FROM lagged l JOIN sizes USING (experiment, participant)),
probs AS (
  SELECT experiment, participant, choice_index, human_choice, prev, k, (u + 0.5) / (choice_index + 0.5 * k) AS base, (r + 0.5) / (t + 1.0) AS theta, (b + 0.5) / (p + 0.5 * k) AS big FROM counted),
online AS (
  SELECT experiment, participant, choice_index, ln(k) AS uniform, -ln(base) AS base_rate,
    -ln(CASE WHEN k = 1 THEN 1.0 WHEN prev IS NULL THEN base WHEN prev = human_choice THEN theta ELSE (1 - theta) / (k - 1) END) AS sticky,
    -ln(CASE WHEN k = 1 THEN 1.0 WHEN prev IS NULL THEN base ELSE big END) AS bigram FROM probs)"""
)
ROUND4 = "round(uniform, 6) AS uniform, round(base_rate, 6) + 0 AS base_rate, round(sticky, 6) + 0 AS sticky, round(bigram, 6) + 0 AS bigram"


def no_minus_zero(frame, columns):
    return frame.select(*(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns))


@query("online_baselines", f"{ONLINE} SELECT experiment, participant, choice_index, {ROUND4} FROM online")
def online_baselines(spark, sf_dir):
    return no_minus_zero(baselines.online(data.choices(spark, sf_dir)), baselines.BASELINES)


MACRO4 = ", ".join(f"avg({b}) AS {b}" for b in baselines.BASELINES)


@query(
    "online_baselines_macro",
    f"{ONLINE} SELECT experiment, {', '.join(f'round(avg({b}), 6) AS {b}' for b in baselines.BASELINES)}, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices FROM (SELECT experiment, participant, {MACRO4}, count(*) AS n FROM online GROUP BY 1, 2) GROUP BY 1",
)
def online_baselines_macro(spark, sf_dir):
    return metrics.macro(baselines.online(data.choices(spark, sf_dir)), baselines.BASELINES)


@query(
    "unpivot_baselines",
    f"{ONLINE}, long AS (UNPIVOT (SELECT experiment, participant, uniform, base_rate, sticky, bigram FROM online) ON uniform, base_rate, sticky, bigram INTO NAME source VALUE nll) SELECT source, experiment, round(avg(m), 6) AS task_nll FROM (SELECT source, experiment, participant, avg(nll) AS m FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def unpivot_baselines(spark, sf_dir):
    scored = baselines.online(data.choices(spark, sf_dir))
    long = scored.unpivot(CHOICE, baselines.BASELINES, "source", "nll")
    return metrics.task_table(long, by=("source", "experiment")).select("source", "experiment", "task_nll")


def _second_run(frame):
    """A second model's run over most of the choices."""
    return frame.where("event_id % 11 <> 0").withColumn("nll", F.col("nll") * (F.lit(0.9) + (F.col("event_id") % 7) / 50))


SECOND = C + ", second AS (SELECT * REPLACE (nll * (0.9 + (event_id % 7) / 50.0) AS nll) FROM choices WHERE event_id % 11 <> 0)"


@query(
    "probability_ratio",
    f"{SECOND}, a AS (SELECT experiment, avg(m) AS l FROM ({PER.format(t='choices')}) GROUP BY 1), b AS (SELECT experiment, avg(m) AS l FROM ({PER.format(t='second')}) GROUP BY 1) SELECT experiment, round(exp(b.l - a.l), 6) AS ratio FROM a JOIN b USING (experiment)",
)
def probability_ratio(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    return metrics.probability_ratio(frame, _second_run(frame))


@query(
    "matched_ratio_coverage",
    f"{SECOND}, m AS (SELECT c.experiment, c.participant, avg(c.nll) AS a, avg(s.nll) AS b, count(*) AS n FROM choices c JOIN second s USING (experiment, participant, choice_index) GROUP BY 1, 2) SELECT m.experiment, round(exp(avg(b) - avg(a)), 6) AS ratio, round(sum(m.n) / any_value(t.n), 6) AS coverage FROM m JOIN (SELECT experiment, count(*) AS n FROM choices GROUP BY 1) t USING (experiment) GROUP BY 1",
)
def matched_ratio_coverage(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    return metrics.matched_ratio(frame, _second_run(frame), "nll")


@query("drop_excluded", f"{C} SELECT experiment, count(*) AS n FROM choices WHERE experiment NOT IN ('w1', 'w3') GROUP BY 1")
def drop_excluded(spark, sf_dir):
    return metrics.drop_excluded(data.choices(spark, sf_dir), ["w1", "w3"]).groupBy("experiment").agg(F.count("*").alias("n"))


@query(
    "replace_sessions",
    f"{C}, r AS (SELECT * REPLACE (9.0 AS nll) FROM choices WHERE CAST(participant AS INTEGER) % 10 = 0 AND choice_index < 2), u AS (SELECT c.* FROM choices c ANTI JOIN r USING (experiment, participant) UNION ALL SELECT * FROM r) SELECT experiment, participant, count(*) AS n, round(avg(nll), 6) AS nll FROM u GROUP BY 1, 2",
)
def replace_sessions(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    other = frame.where((F.col("participant").cast("int") % 10 == 0) & (F.col("choice_index") < 2)).withColumn("nll", F.lit(9.0))
    return metrics.replace_sessions(frame, other).groupBy(*SESSION).agg(F.count("*").alias("n"), F.avg("nll").alias("nll"))


def _runs(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    number = F.col("participant").cast("int")
    parts = [("a", F.lit(True)), ("b", (F.col("experiment") != "w0") | (number % 3 > 0)), ("c", F.col("experiment") != "w2")]
    out = None
    for model, keep in parts:
        part = frame.where(keep).select(F.lit(model).alias("model"), *SESSION, "choice_index", "nll")
        out = part if out is None else out.unionByName(part)
    return out


RUNS = (
    C
    + """, runs AS (SELECT 'a' AS model, experiment, participant, choice_index, nll FROM choices
  UNION ALL SELECT 'b', experiment, participant, choice_index, nll FROM choices WHERE experiment <> 'w0' OR CAST(participant AS INTEGER) % 3 > 0
  UNION ALL SELECT 'c', experiment, participant, choice_index, nll FROM choices WHERE experiment <> 'w2')"""
)


@query(
    "comparability",
    f"{RUNS}, p AS (SELECT DISTINCT model, experiment, participant FROM runs), k AS (SELECT experiment, count(DISTINCT model) AS m FROM p GROUP BY 1), e AS (SELECT experiment, participant, count(*) AS has FROM p GROUP BY 1, 2) SELECT experiment, count(*) FILTER (WHERE has = m) AS n_shared, count(*) AS n_seen, any_value(m) AS n_models FROM e JOIN k USING (experiment) GROUP BY 1 HAVING n_shared < n_seen OR n_models < 3",
)
def comparability(spark, sf_dir):
    return metrics.comparability(_runs(spark, sf_dir))


@query(
    "pivot_metrics",
    f"{RUNS} SELECT experiment, round(avg(m) FILTER (WHERE model = 'a'), 6) AS a, round(avg(m) FILTER (WHERE model = 'b'), 6) AS b, round(avg(m) FILTER (WHERE model = 'c'), 6) AS c FROM (SELECT model, experiment, participant, avg(nll) AS m FROM runs GROUP BY 1, 2, 3) GROUP BY 1",
)
def pivot_metrics(spark, sf_dir):
    table = metrics.task_table(_runs(spark, sf_dir), by=("model", "experiment"))
    return table.groupBy("experiment").pivot("model", ["a", "b", "c"]).agg(F.first("task_nll"))


@query(
    "median_ratio",
    f"{RUNS}, t AS (SELECT model, experiment, avg(m) AS l FROM (SELECT model, experiment, participant, avg(nll * (1 + ascii(model) % 5)) AS m FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT x.model, round(median(exp(y.l - x.l)), 6) AS ratio FROM t x JOIN t y ON x.experiment = y.experiment AND y.model = 'a' GROUP BY 1",
)
def median_ratio(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("nll", F.col("nll") * (1 + F.ascii("model") % 5))
    table = metrics.task_table(runs, by=("model", "experiment")).select("model", "experiment", "task_nll")
    base = table.where("model = 'a'").select("experiment", F.col("task_nll").alias("base"))
    return table.join(base, "experiment").groupBy("model").agg(F.median(F.exp(F.col("base") - F.col("task_nll"))).alias("ratio"))


@query(
    "run_summary",
    f"{C}, s AS (SELECT experiment, participant, avg(nll) AS m FROM choices GROUP BY 1, 2) SELECT round(sum(nll) / sum(num_tokens), 6) AS paper_token_nll, (SELECT round(avg(t), 6) FROM (SELECT avg(m) AS t FROM s GROUP BY experiment)) AS macro_choice_nll, count(*) AS choices, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM choices",
)
def run_summary(spark, sf_dir):
    return metrics.run_summary(data.choices(spark, sf_dir))


@query(
    "paper_summary",
    f"{C} SELECT experiment, round(avg(a / t), 6) AS session_mean, round(sum(a) / sum(t), 6) AS micro, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS choices FROM (SELECT experiment, participant, sum(nll) AS a, sum(num_tokens) AS t, count(*) AS n FROM choices GROUP BY 1, 2) GROUP BY 1",
)
def paper_summary(spark, sf_dir):
    return metrics.paper_summary(data.choices(spark, sf_dir))


POPULATION = (
    C
    + """, lagged AS (SELECT *, lag(human_choice) OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS prev FROM choices),
train AS (SELECT * FROM lagged WHERE CAST(participant AS INTEGER) % 3 > 0), test AS (SELECT * FROM lagged WHERE CAST(participant AS INTEGER) % 3 = 0),
k AS (SELECT experiment, count(DISTINCT human_choice) AS k FROM choices GROUP BY 1), n AS (SELECT experiment, count(*) AS n FROM train GROUP BY 1),
u AS (SELECT experiment, human_choice, count(*) AS u FROM train GROUP BY 1, 2), b AS (SELECT experiment, prev, human_choice, count(*) AS b FROM train WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT experiment, prev, count(*) AS p FROM train WHERE prev IS NOT NULL GROUP BY 1, 2),
scored AS (SELECT t.experiment, t.participant, t.choice_index, -ln((coalesce(u, 0) + 1) / (coalesce(n, 0) + k)) AS pop_base_rate,
  CASE WHEN t.prev IS NULL THEN -ln((coalesce(u, 0) + 1) / (coalesce(n, 0) + k)) ELSE -ln((coalesce(b, 0) + 1) / (coalesce(p, 0) + k)) END AS pop_bigram, ln(k) AS canonical_uniform
  FROM test t JOIN k USING (experiment) LEFT JOIN n USING (experiment) LEFT JOIN u ON t.experiment = u.experiment AND t.human_choice = u.human_choice
  LEFT JOIN b ON t.experiment = b.experiment AND t.human_choice = b.human_choice AND t.prev = b.prev LEFT JOIN p ON t.experiment = p.experiment AND t.prev = p.prev)"""
)


def _population(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    number = F.col("participant").cast("int") % 3
    support = frame.select("experiment", F.col("human_choice").alias("label")).distinct()
    return baselines.population(frame.where(number > 0), frame.where(number == 0), support)


@query("population_baselines", f"{POPULATION} SELECT experiment, participant, choice_index, round(pop_base_rate, 6) AS pop_base_rate, round(pop_bigram, 6) AS pop_bigram, round(canonical_uniform, 6) AS canonical_uniform FROM scored")
def population_baselines(spark, sf_dir):
    return _population(spark, sf_dir)


@query(
    "population_macro",
    f"{POPULATION} SELECT experiment, round(avg(a), 6) AS pop_base_rate, round(avg(b), 6) AS pop_bigram, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices FROM (SELECT experiment, participant, avg(pop_base_rate) AS a, avg(pop_bigram) AS b, count(*) AS n FROM scored GROUP BY 1, 2) GROUP BY 1",
)
def population_macro(spark, sf_dir):
    return metrics.macro(_population(spark, sf_dir), ["pop_base_rate", "pop_bigram"])


@query("sequence_tables", f"{C}, l AS (SELECT *, lag(human_choice) OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS previous FROM choices) SELECT experiment, previous, human_choice AS label, count(*) AS of_pair FROM l WHERE previous IS NOT NULL GROUP BY 1, 2, 3")
def sequence_tables(spark, sf_dir):
    return baselines.sequence_tables(data.choices(spark, sf_dir))["pairs"]


@query("sequence_totals", f"{C}, l AS (SELECT *, lag(human_choice) OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS previous FROM choices) SELECT experiment, count(*) AS n, count(previous) AS steps, count(*) FILTER (WHERE previous = human_choice) AS repeats, count(DISTINCT human_choice) AS k FROM l GROUP BY 1")
def sequence_totals(spark, sf_dir):
    return baselines.sequence_tables(data.choices(spark, sf_dir))["totals"]


@query(
    "prequential_accuracy",
    f"{C}, g AS (SELECT c.experiment, c.participant, c.choice_index, c.human_choice, e.human_choice AS cand, count(*) AS n, min(e.choice_index) AS f FROM choices c JOIN choices e ON c.experiment = e.experiment AND c.participant = e.participant AND e.choice_index < c.choice_index GROUP BY 1, 2, 3, 4, 5), b AS (SELECT *, row_number() OVER (PARTITION BY experiment, participant, choice_index ORDER BY n DESC, f) AS r FROM g) SELECT experiment, round(avg(m), 6) AS accuracy FROM (SELECT experiment, participant, avg(CAST(cand = human_choice AS INTEGER)) AS m FROM b WHERE r = 1 GROUP BY 1, 2) GROUP BY 1",
)
def prequential_accuracy(spark, sf_dir):
    guessed = baselines.running_guess(data.choices(spark, sf_dir)).withColumn("hit", (F.col("guess") == F.col("human_choice")).cast("double"))
    return metrics.macro(guessed, ["hit"]).select("experiment", F.col("hit").alias("accuracy"))


POSITIONS = f"{B}, placed AS (SELECT *, row_number() OVER (PARTITION BY experiment, participant ORDER BY choice_index) - 1 AS rank, count(*) OVER (PARTITION BY experiment, participant) AS len FROM big), d AS (SELECT *, CAST(least(rank * 10 // len, 9) AS INTEGER) AS decile FROM placed)"


def _curve_sql(axis, bucket, where):
    return f"SELECT 'human' AS source, '{axis}' AS axis, experiment, b AS bucket, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices, round(avg(m), 6) AS task_nll, round(exp(-avg(m)), 6) AS task_probability FROM (SELECT experiment, participant, {bucket} AS b, avg(nll) AS m, count(*) AS n FROM d WHERE {where} GROUP BY 1, 2, 3) GROUP BY experiment, b"


@query("session_curve", f"{POSITIONS} {_curve_sql('decile', 'decile', 'true')} UNION ALL {_curve_sql('absolute', 'rank', 'rank < 50')}")
def session_curve(spark, sf_dir):
    return curves.session_curve(data.big_choices(spark, sf_dir).withColumn("source", F.lit("human")))


@query(
    "adaptation_drop",
    f"{POSITIONS}, t AS (SELECT experiment, decile, avg(m) AS l FROM (SELECT experiment, participant, decile, avg(nll) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT experiment, round(arg_min(l, decile), 6) AS first_decile, round(arg_max(l, decile), 6) AS last_decile, round(arg_min(l, decile) - arg_max(l, decile), 6) AS \"drop\" FROM t GROUP BY 1",
)
def adaptation_drop(spark, sf_dir):
    return curves.adaptation_drop(data.big_choices(spark, sf_dir))


@query(
    "trial_macro",
    f"{B}, l AS (SELECT *, max(choice_index) OVER (PARTITION BY experiment, participant) + 1 AS len FROM big) SELECT choice_index, round(avg(t), 6) AS nll, count(*) AS n_tasks FROM (SELECT choice_index, experiment, avg(nll) AS t FROM l WHERE len >= 12 AND choice_index < 10 GROUP BY 1, 2) GROUP BY 1",
)
def trial_macro(spark, sf_dir):
    return curves.trial_macro(data.big_choices(spark, sf_dir), 10, 12)


ANCHORED = W + ", anchored AS (SELECT experiment, participant, choice_index, nll, window_size, target_index, effective_window FROM windows UNION ALL SELECT experiment, participant, choice_index, nll, 1000000, choice_index, choice_index FROM anchors)"


def _anchored(spark, sf_dir):
    return curves.anchored(data.windows(spark, sf_dir), data.big_choices(spark, sf_dir))


def _context_sql(by, where):
    return f"{ANCHORED} SELECT experiment, w AS {by}, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_choices, round(avg(m), 6) AS task_nll, round(exp(-avg(m)), 6) AS task_probability FROM (SELECT experiment, participant, {'window_size' if by == 'window_size' else by} AS w, avg(nll) AS m, count(*) AS n FROM anchored WHERE {where} GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query("context_curve", _context_sql("window_size", "target_index >= 20"))
def context_curve(spark, sf_dir):
    return curves.context_curve(_anchored(spark, sf_dir), "window", 20).withColumnRenamed("window", "window_size")


@query("context_curve_effective", _context_sql("effective_window", "true"))
def context_curve_effective(spark, sf_dir):
    return curves.context_curve(_anchored(spark, sf_dir), "effective_window")


@query("anchor_rank", f"{ANCHORED} SELECT anchor_rank, count(*) AS n FROM (SELECT dense_rank() OVER (PARTITION BY experiment, participant ORDER BY target_index) - 1 AS anchor_rank FROM anchored) GROUP BY 1")
def anchor_rank(spark, sf_dir):
    return curves.anchor_rank(_anchored(spark, sf_dir)).groupBy("anchor_rank").agg(F.count("*").alias("n"))


@query("numerical_floor", f"{ANCHORED} SELECT a.experiment, a.participant, a.choice_index, round(abs(a.nll - b.nll), 6) AS gap FROM anchored a JOIN anchored b USING (experiment, participant, choice_index) WHERE a.window_size = 0 AND b.window_size = 1000000 AND a.target_index = 0")
def numerical_floor(spark, sf_dir):
    return curves.numerical_floor(_anchored(spark, sf_dir))


@query(
    "window_gaps",
    f"{W}, s AS (SELECT experiment, participant, window_size, sum(nll) / sum(num_tokens) AS x FROM (SELECT experiment, participant, window_size, nll, num_tokens FROM windows UNION ALL SELECT experiment, participant, 1000000, nll, num_tokens FROM big) GROUP BY 1, 2, 3), t AS (SELECT experiment, window_size, avg(x) AS v FROM s GROUP BY 1, 2) SELECT t.experiment, t.window_size, round(t.v, 6) AS token_nll, round(t.v - f.v, 6) AS gap FROM t JOIN t f ON t.experiment = f.experiment AND f.window_size = 1000000",
)
def window_gaps(spark, sf_dir):
    limited = data.windows(spark, sf_dir).select(*SESSION, "window", "nll", "num_tokens")
    full = data.big_choices(spark, sf_dir).select(*SESSION, F.lit(curves.FULL).alias("window"), "nll", "num_tokens")
    return curves.window_gaps(limited.unionByName(full)).withColumnRenamed("window", "window_size")


MATCHED = SECOND + ", m AS (SELECT experiment, participant, choice_index, c.nll AS a, s.nll AS b, c.num_tokens AS ta, s.num_tokens AS tb FROM choices c JOIN second s USING (experiment, participant, choice_index))"


def _matched(spark, sf_dir):
    frame = data.choices(spark, sf_dir)
    return integrity.matched(frame, _second_run(frame))


@query("compare_rows", f"{MATCHED} SELECT count(*) AS matched_rows, round(max(abs(b - a)), 6) AS max_delta, round(avg(abs(b - a)), 6) AS mean_delta, round(avg(b - a), 6) AS signed_mean, round(corr(a, b), 6) AS correlation, count(*) FILTER (WHERE ta <> tb) AS token_mismatches FROM m")
def compare_rows(spark, sf_dir):
    return integrity.compare_rows(_matched(spark, sf_dir))


@query("compare_grouped_delta", f"{MATCHED}, g AS (SELECT experiment, abs(avg(b) - avg(a)) AS gap FROM m GROUP BY 1) SELECT round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS mean_gap, count(*) AS \"groups\", arg_max(experiment, gap) AS worst FROM g")
def compare_grouped_delta(spark, sf_dir):
    return integrity.grouped_delta(_matched(spark, sf_dir), ["experiment"])
