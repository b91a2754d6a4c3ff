import math

import pytest

from choicegrid.operators import baselines, integrity, metrics, sampling


def scores(spark, rows):
    return spark.createDataFrame(rows, "experiment string, participant string, choice_index int, nll double")


def near(a, b):
    return abs(a - b) < 1e-9


def test_participants_weigh_alike(spark):
    frame = scores(spark, [("a", "p1", 0, 1.0), ("a", "p2", 0, 0.0), ("a", "p2", 1, 0.0), ("a", "p2", 2, 0.0)])
    row = metrics.task_table(frame).first()
    assert (row.n_participants, row.n_choices) == (2, 4)
    assert near(row.task_nll, 0.5) and near(row.task_probability, math.exp(-0.5))


def test_matched_ratio_and_coverage(spark):
    model = scores(spark, [("a", "p1", 0, 0.5), ("a", "p1", 1, 0.5)])
    row = metrics.matched_ratio(model, scores(spark, [("a", "p1", 0, 1.0)]), "nll").first()
    assert near(row.ratio, math.exp(0.5)) and row.coverage == 0.5


def test_missing_task_fails(spark):
    with pytest.raises(Exception, match="no baseline"):
        metrics.probability_ratio(scores(spark, [("a", "p", 0, 1.0), ("b", "p", 0, 1.0)]), scores(spark, [("a", "p", 0, 1.0)])).collect()


def test_replace_sessions(spark):
    out = metrics.replace_sessions(scores(spark, [("a", "p1", 0, 1.0), ("a", "p2", 0, 2.0)]), scores(spark, [("a", "p1", 0, 9.0)]))
    assert sorted((r.participant, r.nll) for r in out.collect()) == [("p1", 9.0), ("p2", 2.0)]


def test_unique_by(spark):
    frame = scores(spark, [("a", "p", 0, 1.0), ("a", "p", 0, 2.0)])
    with pytest.raises(Exception, match="repeated"):
        metrics.unique_by(frame, ["experiment", "participant", "choice_index"]).collect()


def test_run_and_paper_summary(spark):
    frame = spark.createDataFrame([("a", "1", 0, 2.0, 1), ("a", "1", 1, 4.0, 2), ("a", "2", 0, 8.0, 1)], "experiment string, participant string, choice_index int, nll double, num_tokens int")
    row = metrics.run_summary(frame).first()
    assert (row.paper_token_nll, row.macro_choice_nll, row.choices, row.tokens) == (3.5, 5.5, 3, 4)


def sequence(spark, labels):
    return spark.createDataFrame([("a", "p", i, x) for i, x in enumerate(labels)], "experiment string, participant string, choice_index int, human_choice string")


def test_online_baselines_by_hand(spark):
    rows = baselines.online(sequence(spark, "ABB")).orderBy("choice_index").collect()
    for name, wanted in {"base_rate": (0.5, 0.25, 0.5), "sticky": (0.5, 0.5, 0.25), "bigram": (0.5, 0.5, 0.5), "uniform": (0.5, 0.5, 0.5)}.items():
        assert all(near(r[name], -math.log(p)) for r, p in zip(rows, wanted, strict=True)), name


def test_single_label_is_certain(spark):
    assert all(near(r[n], 0.0) for r in baselines.online(sequence(spark, "AAA")).collect() for n in baselines.BASELINES)


def test_population_by_hand(spark):
    support = spark.createDataFrame([("a", "a"), ("a", "b")], "experiment string, label string")
    rows = baselines.population(sequence(spark, "aab"), sequence(spark, "aba"), support).orderBy("choice_index").collect()
    assert all(near(r.pop_base_rate, -math.log(p)) for r, p in zip(rows, (3 / 5, 2 / 5, 3 / 5), strict=True))
    assert all(near(r.pop_bigram, -math.log(p)) for r, p in zip(rows, (3 / 5, 2 / 4, 1 / 2), strict=True))


def test_running_guess_first_seen_wins(spark):
    rows = baselines.running_guess(sequence(spark, "BAABBA")).orderBy("choice_index").collect()
    assert [r.guess for r in rows] == ["B", "B", "A", "B", "B"]


def test_compare(spark):
    kind = "experiment string, participant string, choice_index int, nll double, num_tokens int"
    a = spark.createDataFrame([("a", "1", i, float(i), 1) for i in range(4)], kind)
    b = spark.createDataFrame([("a", "1", i, i + 0.01, 1) for i in range(4)], kind)
    row = integrity.compare_rows(integrity.matched(a, b)).first()
    assert near(row.max_delta, 0.01) and near(row.signed_mean, 0.01) and near(row.correlation, 1.0) and row.token_mismatches == 0
    flat = integrity.compare_rows(integrity.matched(a.withColumn("nll", a.nll * 0), b)).first()
    assert flat.correlation is None
    assert integrity.verdict(row.asDict(), 0.01, 1e-3, 0.05, 0.999) == ["a task's mean is off"]
    assert integrity.verdict(row.asDict(), 0.01, 0.02, 0.05, 0.999) == []


def test_length_filter_is_inclusive(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (10, 100, 200)], "text string")
    assert [f.count() for f in sampling.split_by_length(rows, 100)] == [2, 1]
    assert [f.count() for f in sampling.split_by_length(rows, 10)] == [1, 2]


def test_split_of_a_tiny_table(spark):
    rows = spark.createDataFrame([("a",)], "k string")
    assert [f.count() for f in sampling.split_train_eval(rows, ["k"], 0.5)] == [1, 1]


def test_unique_rows_are_hashed(spark):
    frame = spark.createDataFrame([("a", "1", 0, 0.5)], "experiment string, participant string, choice_index int, nll double")
    once = metrics.unique_by(frame, ["experiment", "participant", "choice_index"])
    assert once.columns == frame.columns and "SortAggregate" not in once._jdf.queryExecution().executedPlan().toString()
