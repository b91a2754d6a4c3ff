"""Engine tables made from the driver's tables, each with the same definition in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_targets
from ..schemas import SESSION

LABELS = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choices(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Sessions of events: experiment is the week, participant the user.

    dealt: over as many partitions as shuffles have, where far more is made of a session than its bytes show, by which Spark
    would join partitions.
    """
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    week = F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    rows = events.select(week.alias("experiment"), F.col("user_id").cast("string").alias("participant"), "event_id", "ts", F.col("event_type").alias("human_choice"), "value")
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *SESSION)
    order = Window.partitionBy(*SESSION).orderBy("ts", "event_id")
    return rows.select(
        *SESSION,
        (F.row_number().over(order) - 1).cast("long").alias("choice_index"),
        "event_id",
        "human_choice",
        (F.col("value") / 100).alias("nll"),
        (1 + (F.col("event_id") % 5 == 0).cast("int")).alias("num_tokens"),
    )


CHOICES = """choices AS (
  SELECT 'w' || CAST((day(ts) - 1) // 7 AS VARCHAR) AS experiment, CAST(user_id AS VARCHAR) AS participant,
    row_number() OVER (PARTITION BY (day(ts) - 1) // 7, user_id ORDER BY ts, event_id) - 1 AS choice_index,
    event_id, event_type AS human_choice, value / 100.0 AS nll, 1 + CAST(event_id % 5 = 0 AS INTEGER) AS num_tokens
  FROM events)"""


def big_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer sessions, of line items: experiment is flag and status, participant the supplier."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("experiment"), F.col("l_suppkey").cast("string").alias("participant"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    order = Window.partitionBy(*SESSION).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.select(
        *SESSION,
        (F.row_number().over(order) - 1).cast("long").alias("choice_index"),
        F.concat(F.lit("q"), F.floor((F.col("l_quantity") - 1) / 10).cast("string")).alias("human_choice"),
        (F.col("l_discount") * 10 + F.col("l_tax")).alias("nll"),
        (1 + (F.col("l_orderkey") % 5 == 0).cast("int")).alias("num_tokens"),
    )


BIG_CHOICES = """big AS (
  SELECT l_returnflag || l_linestatus AS experiment, CAST(l_suppkey AS VARCHAR) AS participant,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS choice_index,
    'q' || CAST(CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS VARCHAR) AS human_choice,
    l_discount * 10 + l_tax AS nll, 1 + CAST(l_orderkey % 5 = 0 AS INTEGER) AS num_tokens
  FROM lineitem)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of choices: a header, a blank line, one marked choice per line; every seventh choice has a second mark on its line."""
    rows = choices(spark, sf_dir)
    twice = F.when(F.col("event_id") % 7 == 0, F.lit(" again <<ok>>")).otherwise(F.lit(""))
    line = F.concat(F.lit("Trial "), F.col("choice_index").cast("string"), F.lit(": You press <<"), "human_choice", F.lit(">>."), twice, F.lit("\n"))
    lines = rows.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("choice_index", line.alias("line")))).alias("x"))
    return lines.select(*SESSION, F.concat(F.lit("Task "), "experiment", F.lit("\n \nRules.\n\n"), F.array_join("x.line", ""), F.lit("end")).alias("text"))


SESSIONS = (
    CHOICES
    + """, sessions AS (
  SELECT experiment, participant, 'Task ' || experiment || chr(10) || ' ' || chr(10) || 'Rules.' || chr(10) || chr(10) ||
    string_agg('Trial ' || CAST(choice_index AS VARCHAR) || ': You press <<' || human_choice || '>>.' ||
      CASE WHEN event_id % 7 = 0 THEN ' again <<ok>>' ELSE '' END || chr(10), '' ORDER BY choice_index) || 'end' AS text
  FROM choices GROUP BY 1, 2)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's readouts of choices: some right, some off the options in every way that is told apart."""
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.col("human_choice")).otherwise(F.element_at(F.array(*map(F.lit, LABELS)), (e % 5 + 1).cast("int")))
    odd = (
        F.when(e % 11 == 1, F.concat(F.lit(" "), said)).when(e % 11 == 2, F.upper(said)).when(e % 11 == 3, F.substr(said, F.lit(1), F.lit(3))).when(e % 11 == 4, F.lit("   "))
        .when(e % 11 == 5, F.lit("?!")).when(e % 11 == 6, F.lit("well, I")).otherwise(said)
    )
    ok = ~(e % 11).between(1, 6)
    status = F.when(e % 13 == 0, "multi_token_option").otherwise("scored")
    return choices(spark, sf_dir).withColumn("pred_choice", said).withColumn("raw_generation", odd).withColumn("format_ok", ok).withColumn("options_status", status)


PREDICTIONS = (
    CHOICES
    + """, said AS (
  SELECT *, CASE WHEN event_id % 3 = 0 THEN human_choice ELSE list_extract(['click', 'error', 'purchase', 'signup', 'view'], CAST(event_id % 5 + 1 AS INTEGER)) END AS pred_choice FROM choices),
predictions AS (
  SELECT *, CASE event_id % 11 WHEN 1 THEN ' ' || pred_choice WHEN 2 THEN upper(pred_choice) WHEN 3 THEN substr(pred_choice, 1, 3) WHEN 4 THEN '   ' WHEN 5 THEN '?!'
      WHEN 6 THEN 'well, I' ELSE pred_choice END AS raw_generation,
    event_id % 11 NOT BETWEEN 1 AND 6 AS format_ok, CASE WHEN event_id % 13 = 0 THEN 'multi_token_option' ELSE 'scored' END AS options_status
  FROM said)"""
)


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of the five labels at every scored choice."""
    rows = predictions(spark, sf_dir).where("options_status = 'scored'")
    weights = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (1 + (F.col("event_id") * i) % 7).cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    # as columns of their own, or the total is found anew for every option
    rows = rows.select(*SESSION, "choice_index", weights.alias("weights"), total.alias("total"))
    each = rows.select(*SESSION, "choice_index", "total", F.posexplode("weights").alias("place", "weight"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("place") + 1)
    return each.select(*SESSION, "choice_index", label.alias("option"), F.ln(F.col("weight") / (F.col("total") * 1.25)).alias("logprob"))


OPTIONS = (
    PREDICTIONS
    + """, weights AS (
  SELECT experiment, participant, choice_index, i, 1 + (event_id * i) % 7 AS weight FROM predictions, range(1, 6) AS r(i) WHERE options_status = 'scored'),
options AS (
  SELECT experiment, participant, choice_index, list_extract(['click', 'error', 'purchase', 'signup', 'view'], CAST(i AS INTEGER)) AS option,
    ln(weight / (sum(weight) OVER (PARTITION BY experiment, participant, choice_index) * 1.25)) AS logprob FROM weights)"""
)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), "label")


LOGITS = "logits AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS logits, label FROM embeddings)"


def canonical(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The table behind the choices, with codes in place of each session's own labels, forced trials and misses mixed in.

    Participants fall into four kinds by their number: the table fits as it is, with forced rows, with misses, or not at all.
    """
    rows = choices(spark, sf_dir, dealt)
    kind = F.col("participant").cast("int") % 4
    code = code_of(F.col("human_choice"), F.col("participant").cast("int"))
    own = F.struct((F.col("choice_index") * 2).alias("row_idx"), code.cast("double").alias("value"), F.lit(0).alias("forced"))
    extra = F.struct((F.col("choice_index") * 2 + 1).alias("row_idx"), F.when(kind == 2, -1.0).otherwise(1.0).alias("value"), F.when(kind == 1, 1).otherwise(0).alias("forced"))
    each = F.when((F.col("choice_index") % 3 == 0) & (kind > 0), F.array(own, extra)).otherwise(F.array(own))
    return rows.select(*SESSION, block(F.col("choice_index")).alias("block"), F.inline(each)).select(*SESSION, "row_idx", "value", "forced", "block")


def code_of(label, participant):
    """A label's code differs between participants: the labels' order is rotated."""
    place = F.array_position(F.array(*map(F.lit, LABELS)), label) - 1
    return (place + participant) % 5


def block(choice_index):
    return (choice_index % 2).cast("string")


CANONICAL = (
    CHOICES
    + """, base AS (
  SELECT *, CAST(participant AS INTEGER) AS p, (list_position(['click', 'error', 'purchase', 'signup', 'view'], human_choice) - 1 + CAST(participant AS INTEGER)) % 5 AS code0 FROM choices),
canonical AS (
  SELECT experiment, participant, choice_index * 2 AS row_idx, CAST(code0 AS DOUBLE) AS value, 0 AS forced, CAST(choice_index % 2 AS VARCHAR) AS block FROM base
  UNION ALL
  SELECT experiment, participant, choice_index * 2 + 1, CASE WHEN p % 4 = 2 THEN -1.0 ELSE 1.0 END, CASE WHEN p % 4 = 1 THEN 1 ELSE 0 END, CAST(choice_index % 2 AS VARCHAR)
  FROM base WHERE choice_index % 3 = 0 AND p % 4 > 0),
lengths AS (SELECT experiment, participant, count(*) AS n FROM choices GROUP BY 1, 2),
counted AS (
  SELECT experiment, participant, count(*) AS raw, count(*) FILTER (WHERE forced = 0) AS free, count(*) FILTER (WHERE value >= 0) AS answered FROM canonical GROUP BY 1, 2),
ruled AS (
  SELECT experiment, participant, CASE WHEN raw = n THEN 'raw' WHEN free = n THEN 'forced==0' WHEN answered = n THEN 'code>=0' END AS rule
  FROM lengths JOIN counted USING (experiment, participant)),
kept AS (
  SELECT c.*, rule, row_number() OVER (PARTITION BY c.experiment, c.participant ORDER BY row_idx) AS ordinal FROM canonical c JOIN ruled r
  ON c.experiment = r.experiment AND c.participant = r.participant AND (rule = 'raw' OR (rule = 'forced==0' AND forced = 0) OR (rule = 'code>=0' AND value >= 0))),
aligned AS (
  SELECT c.experiment, c.participant, c.choice_index, k.block, CAST(CAST(k.value AS BIGINT) AS VARCHAR) AS code, c.human_choice AS label, k.rule
  FROM (SELECT *, row_number() OVER (PARTITION BY experiment, participant ORDER BY choice_index) AS ordinal FROM choices) c
  JOIN kept k ON c.experiment = k.experiment AND c.participant = k.participant AND c.ordinal = k.ordinal WHERE k.value >= 0)"""
)


def is_anchor(choice_index, length):
    """Whether a choice is one of the five anchors of its session."""
    return F.array_contains(anchor_targets(length.cast("int")), choice_index.cast("int"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choices of the longer sessions that the grid over each session's own length takes."""
    length = F.count("*").over(Window.partitionBy(*SESSION))
    rows = big_choices(spark, sf_dir).withColumn("n_segments", length)
    return rows.where(is_anchor(F.col("choice_index"), F.col("n_segments")))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor choices of the longer sessions under windows 0, 1, 2 and 5."""
    each = anchors(spark, sf_dir).withColumn("window", F.explode(F.array(*map(F.lit, (0, 1, 2, 5))))).withColumn("target_index", F.col("choice_index"))
    effective = F.least("window", "target_index")
    return each.select(*SESSION, "choice_index", "num_tokens", (F.col("nll") + 1 / (F.lit(2.0) + effective)).alias("nll"), "window", "target_index", effective.alias("effective_window"))


WINDOWS = (
    BIG_CHOICES
    + """, lengths AS (SELECT experiment, participant, count(*) AS n, count(*) - 1 AS l FROM big GROUP BY 1, 2),
first_inner AS (SELECT *, least(greatest(CAST(round_even(0.1 * l, 0) AS BIGINT), 2), n - 3) AS a FROM lengths WHERE n > 5),
second_inner AS (SELECT *, least(greatest(CAST(round_even(0.5 * l, 0) AS BIGINT), a + 1), n - 2) AS b FROM first_inner),
grid AS (SELECT experiment, participant, unnest([0, 1, a, b, l]) AS choice_index FROM second_inner UNION ALL SELECT experiment, participant, unnest(range(0, n)) FROM lengths WHERE n <= 5),
anchors AS (SELECT big.* FROM big JOIN grid USING (experiment, participant, choice_index)), windows AS (
  SELECT experiment, participant, choice_index, num_tokens, nll + 1 / (2.0 + least(w, choice_index)) AS nll, w AS window_size, choice_index AS target_index, least(w, choice_index) AS effective_window
  FROM anchors, (VALUES (0), (1), (2), (5)) AS t(w))"""
)
