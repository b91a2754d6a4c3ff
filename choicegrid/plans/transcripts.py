"""Transcripts, windows, grids, logits, and which sessions a run takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logits as lg
from ..functions import text as tx
from ..functions.scalars import canonical_code, first_prefix
from ..operators import sampling
from ..schemas import SESSION
from ..sources import testdata as data
from .registry import query

S, L, C = f"WITH {data.SESSIONS}", f"WITH {data.LOGITS}", f"WITH {data.CHOICES}"
SPANS = "regexp_extract_all(text, '<<(.*?)>>', 1, 's')"


@query("spans", f"{S}, x AS (SELECT experiment, participant, {SPANS} AS labels FROM sessions) SELECT experiment, participant, i - 1 AS choice_index, labels[i] AS label FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM x)")
def spans(spark, sf_dir):
    return data.sessions(spark, sf_dir).select(*SESSION, F.posexplode(tx.choices(F.col("text"))).alias("choice_index", "label")).withColumn("choice_index", F.col("choice_index").cast("long"))


@query("span_counts", f"{S} SELECT experiment, participant, CAST(len({SPANS}) AS INTEGER) AS n FROM sessions")
def span_counts(spark, sf_dir):
    return data.sessions(spark, sf_dir).select(*SESSION, F.size(tx.choices(F.col("text"))).alias("n"))


@query(
    "span_places",
    f"{S}, b AS (SELECT experiment, participant, text, regexp_split_to_array(text, '<<|>>') AS p FROM sessions) SELECT experiment, participant, CAST(sum(e) AS BIGINT) AS sum_of_ends, count(*) AS n FROM (SELECT experiment, participant, i, list_sum(list_transform(p[1:2 * i], lambda v: length(v))) + 2 * (2 * i - 1) AS e FROM (SELECT *, unnest(range(1, len(p) // 2 + 1)) AS i FROM b)) GROUP BY 1, 2",
)
def span_places(spark, sf_dir):
    each = data.sessions(spark, sf_dir).select(*SESSION, F.explode(tx.span_places(F.col("text"))).alias("p"))
    return each.groupBy(*SESSION).agg(F.sum("p.end").alias("sum_of_ends"), F.count("*").alias("n"))


SEGMENTED = S + ", segmented AS (SELECT experiment, participant, text, regexp_extract(text, '^(.*Rules\\.\\n\\n)', 1, 's') AS header, regexp_extract_all(text, 'Trial [^\\n]*\\n') AS segments FROM sessions)"


def _segmented(spark, sf_dir):
    text = F.col("text")
    return data.sessions(spark, sf_dir).select(*SESSION, "text", tx.header(text).alias("header"), tx.segments(text).alias("segments"), tx.tail(text).alias("tail"))


@query("segments", f"{SEGMENTED} SELECT experiment, participant, i - 1 AS segment_index, segments[i] AS segment FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM segmented)")
def segments(spark, sf_dir):
    return _segmented(spark, sf_dir).select(*SESSION, F.posexplode("segments").alias("segment_index", "segment")).withColumn("segment_index", F.col("segment_index").cast("long"))


@query("segment_header", f"{SEGMENTED} SELECT experiment, participant, header, 'end' AS tail, true AS lossless FROM segmented")
def segment_header(spark, sf_dir):
    lossless = F.concat("header", F.array_join("segments", ""), "tail") == F.col("text")
    return _segmented(spark, sf_dir).select(*SESSION, "header", "tail", lossless.alias("lossless"))


@query("window_prompts", f"{SEGMENTED} SELECT experiment, participant, w AS window_size, md5(header || array_to_string(segments[greatest(len(segments) - w, 1):len(segments)], '')) AS prompt FROM segmented, (VALUES (0), (1), (2)) AS t(w)")
def window_prompts(spark, sf_dir):
    each = _segmented(spark, sf_dir).withColumn("window_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    prompt = tx.window_prompt(F.col("header"), F.col("segments"), F.size("segments") - 1, F.col("window_size"))
    return each.select(*SESSION, "window_size", F.md5(prompt).alias("prompt"))


@query("all_window_prompts", f"{SEGMENTED} SELECT experiment, participant, t AS target_index, w AS window_size, md5(header || array_to_string(segments[greatest(t - w, 0) + 1:t + 1], '')) AS prompt FROM (SELECT *, unnest(range(0, len(segments))) AS t FROM segmented), (VALUES (0), (1), (2), (1000000)) AS v(w)")
def all_window_prompts(spark, sf_dir):
    """Every target of every session under every window."""
    each = _segmented(spark, sf_dir).withColumn("target_index", F.explode(F.sequence(F.lit(0), F.size("segments") - 1)))
    each = each.withColumn("window_size", F.explode(F.array(*map(F.lit, (0, 1, 2, 1_000_000)))))
    prompt = tx.window_prompt(F.col("header"), F.col("segments"), F.col("target_index"), F.col("window_size"))
    return each.select(*SESSION, F.col("target_index").cast("long").alias("target_index"), "window_size", F.md5(prompt).alias("prompt"))


SESSION_GRIDS = f"""{SEGMENTED}, n AS (SELECT experiment, participant, len(segments) AS n, len(segments) - 1 AS l FROM segmented),
c AS (SELECT *, least(greatest(CAST(round_even(0.1 * l, 0) AS BIGINT), 2), n - 3) AS a FROM n WHERE n > 5), d AS (SELECT *, least(greatest(CAST(round_even(0.5 * l, 0) AS BIGINT), a + 1), n - 2) AS b FROM c)
SELECT experiment, participant, 'anchor' AS grid, CAST(t AS INTEGER) AS target FROM (SELECT experiment, participant, unnest([0, 1, a, b, l]) AS t FROM d UNION ALL SELECT experiment, participant, unnest(range(0, n)) FROM n WHERE n <= 5)
UNION ALL SELECT DISTINCT experiment, participant, 'even', CAST(t AS INTEGER) FROM (SELECT experiment, participant, unnest(range(0, n)) AS t FROM n WHERE n <= 5
  UNION ALL SELECT experiment, participant, unnest([0, CAST(round_even(l / 4.0, 0) AS BIGINT), CAST(round_even(l / 2.0, 0) AS BIGINT), CAST(round_even(l * 0.75, 0) AS BIGINT), l]) FROM n WHERE n > 5)"""


@query("session_grids", SESSION_GRIDS)
def session_grids(spark, sf_dir):
    """Both grids over each session's own number of segments."""
    n = _segmented(spark, sf_dir).select(*SESSION, F.size("segments").alias("n"))
    kinds = F.map_from_arrays(F.array(F.lit("anchor"), F.lit("even")), F.array(tx.anchor_targets(F.col("n")), tx.even_targets(F.col("n"), 5)))
    return n.select(*SESSION, F.explode(kinds).alias("grid", "targets")).select(*SESSION, "grid", F.explode("targets").alias("target"))


@query("grid_even", "SELECT CAST(n AS INTEGER) AS n, CAST(t AS INTEGER) AS target FROM range(1, 200) AS r(n), range(0, 200) AS s(t) WHERE t < n AND (n <= 5 OR t IN (0, CAST(round_even((n - 1) / 4.0, 0) AS INTEGER), CAST(round_even((n - 1) / 2.0, 0) AS INTEGER), CAST(round_even((n - 1) * 0.75, 0) AS INTEGER), n - 1))")
def grid_even(spark, sf_dir):
    return spark.range(1, 200).select(F.col("id").cast("int").alias("n")).select("n", F.explode(tx.even_targets(F.col("n"), 5)).alias("target"))


@query(
    "grid_anchor",
    """WITH n AS (SELECT CAST(n AS INTEGER) AS n, n - 1 AS l FROM range(1, 200) AS r(n)),
c AS (SELECT n, l, CAST(least(greatest(round_even(0.1 * l, 0), 2), n - 3) AS INTEGER) AS a FROM n WHERE n > 5),
d AS (SELECT n, l, a, CAST(least(greatest(round_even(0.5 * l, 0), a + 1), n - 2) AS INTEGER) AS b FROM c)
SELECT n, CAST(t AS INTEGER) AS target FROM (SELECT n, unnest([0, 1, a, b, l]) AS t FROM d UNION ALL SELECT n, unnest(range(0, n)) FROM n WHERE n <= 5)""",
)
def grid_anchor(spark, sf_dir):
    return spark.range(1, 200).select(F.col("id").cast("int").alias("n")).select("n", F.explode(tx.anchor_targets(F.col("n"))).alias("target"))


@query(
    "window_cells",
    f"{SEGMENTED}, cells AS (SELECT experiment, participant, t, w FROM (SELECT *, unnest(range(0, len(segments))) AS t FROM segmented), (VALUES (0), (1), (2), (1000000)) AS v(w)) SELECT experiment, participant, count(*) AS observations, count(DISTINCT (t, least(t, w))) AS cells FROM cells GROUP BY 1, 2",
)
def window_cells(spark, sf_dir):
    """Equal prompts are asked for once: a window beyond the session's start is the same as the shorter one."""
    grid = _segmented(spark, sf_dir).select(*SESSION, F.explode(F.sequence(F.lit(0), F.size("segments") - 1)).alias("t"))
    grid = grid.withColumn("w", F.explode(F.array(*map(F.lit, (0, 1, 2, 1_000_000)))))
    return grid.groupBy(*SESSION).agg(F.count("*").alias("observations"), F.countDistinct("t", F.least("t", "w")).alias("cells"))


@query("global_choice_index", f"{SEGMENTED}, e AS (SELECT experiment, participant, i, len(regexp_extract_all(segments[i], '<<(.*?)>>')) AS n FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM segmented)) SELECT experiment, participant, i - 1 AS segment_index, CAST(coalesce(sum(n) OVER (PARTITION BY experiment, participant ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_choice FROM e")
def global_choice_index(spark, sf_dir):
    from pyspark.sql import Window

    each = segments(spark, sf_dir).withColumn("n", F.size(tx.choices(F.col("segment"))))
    before = Window.partitionBy(*SESSION).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*SESSION, "segment_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_choice"))


LP = L + ", t AS (SELECT vec_id, label, logits, list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) AS z FROM logits), lp AS (SELECT vec_id, label, list_transform(logits, lambda v: v - z) AS lp FROM t)"


def _logprobs(spark, sf_dir):
    return data.logits(spark, sf_dir).select("vec_id", "label", lg.log_softmax(F.col("logits")).alias("lp"))


@query("log_softmax", f"{LP} SELECT vec_id, round(lp[1], 6) AS first_logprob, round(-lp[label + 1], 6) AS nll, round(list_sum(list_transform(lp, lambda v: exp(v))), 6) AS mass FROM lp")
def log_softmax(spark, sf_dir):
    mass = F.aggregate("lp", F.lit(0.0), lambda s, x: s + F.exp(x))
    return _logprobs(spark, sf_dir).select("vec_id", F.get("lp", F.lit(0)).alias("first_logprob"), (-F.get("lp", F.col("label"))).alias("nll"), mass.alias("mass"))


@query("topk_tokens", f"{LP}, e AS (SELECT vec_id, unnest(lp) AS x, unnest(range(0, len(lp))) AS token_id FROM lp) SELECT vec_id, r - 1 AS rank, CAST(token_id AS INTEGER) AS token_id, round(x, 6) AS logprob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, token_id) AS r FROM e) WHERE r <= 5")
def topk_tokens(spark, sf_dir):
    each = _logprobs(spark, sf_dir).select("vec_id", F.posexplode(lg.top_k(F.col("lp"), 5)).alias("rank", "t"))
    return each.select("vec_id", F.col("rank").cast("long").alias("rank"), "t.token_id", (-F.col("t.neg")).alias("logprob"))


@query("argmax_token", f"{L} SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS token_id FROM logits")
def argmax_token(spark, sf_dir):
    return data.logits(spark, sf_dir).select("vec_id", lg.argmax(F.col("logits")).alias("token_id"))


@query("legal_mass", f"{LP} SELECT vec_id, round(list_sum(list_transform(lp[1:10], lambda v: exp(v))), 6) AS legal_mass FROM lp")
def legal_mass(spark, sf_dir):
    ten = F.sequence(F.lit(0), F.lit(9))
    return _logprobs(spark, sf_dir).select("vec_id", lg.option_mass(F.col("lp"), ten).alias("legal_mass"))


@query("entropy", f"{LP} SELECT vec_id, round(-list_sum(list_transform(lp, lambda v: exp(v) * v)), 6) AS entropy, round(exp(list_max(lp)), 6) AS top_probability FROM lp")
def entropy(spark, sf_dir):
    return _logprobs(spark, sf_dir).select("vec_id", lg.entropy(F.col("lp")).alias("entropy"), F.exp(F.array_max("lp")).alias("top_probability"))


@query("format_ok", f"{L} SELECT vec_id, list_position(logits, list_max(logits)) - 1 < 10 AS format_ok FROM logits")
def format_ok(spark, sf_dir):
    return data.logits(spark, sf_dir).select("vec_id", F.array_contains(F.sequence(F.lit(0), F.lit(9)), lg.argmax(F.col("logits"))).alias("format_ok"))


@query("option_status", "SELECT vec_id, CASE WHEN vec_id % 7 > 4 THEN 'too_many_options' WHEN vec_id % 5 = 0 THEN 'tokenization_mismatch' WHEN vec_id % 3 = 0 THEN 'multi_token_option' ELSE 'scored' END AS status FROM embeddings")
def option_status(spark, sf_dir):
    rows = data.logits(spark, sf_dir).select("vec_id")
    one = F.when(F.col("vec_id") % 5 == 0, F.lit(None).cast("int")).otherwise(1)
    counts = F.concat(F.array(one, F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1)), F.array_repeat(F.lit(1), (F.col("vec_id") % 7).cast("int")))
    return rows.select("vec_id", lg.option_status(counts, 6).alias("status"))


@query("canonical_codes", "WITH v AS (SELECT o_orderkey, list_extract(['1.0', ' 2 ', '-1', 'nan', '', 'a b', '1.5', 'None'], CAST(o_orderkey % 8 + 1 AS INTEGER)) AS value FROM orders) SELECT o_orderkey, CASE value WHEN '1.0' THEN '1' WHEN ' 2 ' THEN '2' WHEN 'a b' THEN 'a b' WHEN '1.5' THEN '1.5' END AS code FROM v")
def canonical_codes(spark, sf_dir):
    values = F.array(*map(F.lit, ("1.0", " 2 ", "-1", "nan", "", "a b", "1.5", "None")))
    return data.read(spark, sf_dir, "orders").select("o_orderkey", canonical_code(F.get(values, (F.col("o_orderkey") % 8).cast("int"))).alias("code"))


@query("prefix_class", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'a') THEN 'A' WHEN starts_with(p_type, 'x') THEN 'X' WHEN starts_with(p_brand, 'Brand#1') THEN 'one' WHEN starts_with(p_brand, 'Brand#') THEN 'brand' END AS task FROM part")
def prefix_class(spark, sf_dir):
    part = data.read(spark, sf_dir, "part")
    name = F.coalesce(first_prefix(F.col("p_name"), [("a", "A")]), first_prefix(F.col("p_type"), [("x", "X")]), first_prefix(F.col("p_brand"), [("Brand#1", "one"), ("Brand#", "brand")]))
    return part.select("p_partkey", name.alias("task"))


ROWS = S + ", rows AS (SELECT *, row_number() OVER (ORDER BY experiment, CAST(participant AS INTEGER)) - 1 AS row_idx FROM sessions)"


def _rows(spark, sf_dir):
    """Sessions with the number that the input's order gives them; here the order of week and user."""
    every = data.choices(spark, sf_dir).groupBy("experiment").agg(F.countDistinct("participant").alias("n"))
    from pyspark.sql import Window

    # one row per task: how many sessions the tasks before it have
    before = every.select("experiment", F.coalesce(F.sum("n").over(Window.orderBy("experiment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("experiment").orderBy(F.col("participant").cast("int"))) - 1
    return data.sessions(spark, sf_dir).join(before, "experiment").withColumn("row_idx", F.col("start") + place).drop("start")


@query("shard_mod", f"{ROWS} SELECT experiment, participant FROM rows WHERE row_idx % 4 = 1")
def shard_mod(spark, sf_dir):
    return sampling.modulo_shard(_rows(spark, sf_dir), 1, 4).select(*SESSION)


@query("prefix_limit", f"{ROWS} SELECT experiment, participant FROM rows WHERE row_idx < 25")
def prefix_limit(spark, sf_dir):
    return sampling.prefix_limit(_rows(spark, sf_dir), 25).select(*SESSION)


@query("sample_per_group", f"{C}, s AS (SELECT DISTINCT experiment, participant FROM choices) SELECT experiment, participant FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY md5('7|' || experiment || '|' || participant)) AS r FROM s) WHERE r <= 5")
def sample_per_group(spark, sf_dir):
    return sampling.sample_per_group(data.choices(spark, sf_dir).select(*SESSION).distinct(), "experiment", SESSION, 5, 7)


@query("skip_report", f"{S} SELECT experiment, count(*) FILTER (WHERE length(text) > 400) AS skipped, count(*) AS total, CAST(floor(median(length(text)) FILTER (WHERE length(text) > 400)) AS BIGINT) AS median_chars, count(*) FILTER (WHERE length(text) > 400) = count(*) AS whole_task FROM sessions GROUP BY 1 HAVING skipped > 0")
def skip_report(spark, sf_dir):
    return sampling.skip_report(data.sessions(spark, sf_dir), 400)


@query("length_filter", f"{S} SELECT experiment, participant, length(text) AS chars FROM sessions WHERE length(text) <= 400")
def length_filter(spark, sf_dir):
    kept, _ = sampling.split_by_length(data.sessions(spark, sf_dir), 400)
    return kept.select(*SESSION, F.length("text").cast("long").alias("chars"))


@query("choice_distribution", f"{C} SELECT experiment, human_choice, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY experiment), 6) AS share FROM choices GROUP BY 1, 2")
def choice_distribution(spark, sf_dir):
    from pyspark.sql import Window

    counts = data.choices(spark, sf_dir).groupBy("experiment", "human_choice").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("experiment")))


@query("sessions_per_task", f"{C} SELECT experiment, count(DISTINCT participant) AS n FROM choices GROUP BY 1")
def sessions_per_task(spark, sf_dir):
    return data.choices(spark, sf_dir).groupBy("experiment").agg(F.countDistinct("participant").alias("n"))
