"""Row numbers of a scan over many splits and files, and exact quantiles of large groups."""

import json
import random

import pytest
from pyspark.sql import functions as F

from choicegrid.operators import canonical, readouts, sampling
from choicegrid.operators.joins import join_keyed
from choicegrid.operators.quantiles import exact_quantile
from choicegrid.sources import readers


def test_row_numbers_over_splits_and_files(spark, tmp_path):
    rng, wanted = random.Random(1), []
    for name, n in (("b.jsonl", 700), ("a.jsonl", 300), ("c.jsonl", 0), ("d.jsonl", 1)):
        lines = []
        for i in range(n):
            row = {"experiment": None if i % 50 == 3 else name, "participant": i, "text": "é" * rng.randint(0, 300)}
            lines.append(json.dumps(row, ensure_ascii=False))
            if i % 40 == 7:
                lines.append("")  # a blank line is no row
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (n > 0), encoding="utf-8")
    wanted = [("a.jsonl", i) for i in range(300)] + [("b.jsonl", i) for i in range(700)] + [("d.jsonl", 0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = readers.read_sessions(spark, str(tmp_path))
        assert readers.read_sessions(spark, str(tmp_path), numbered=False).rdd.getNumPartitions() > 20
        found = {r.row_idx: (r.experiment, int(r.participant)) for r in rows.collect()}
        assert rows.columns == ["experiment", "participant", "text", "row_idx"]
        assert sorted(found) == list(range(len(wanted)))
        assert all(found[k][1] == i and found[k][0] in (name, None) for k, (name, i) in enumerate(wanted))
        assert sorted(r.row_idx for r in sampling.modulo_shard(rows, 1, 4).collect()) == list(range(1, len(wanted), 4))
        assert {r.row_idx for r in sampling.prefix_limit(rows, 25).select("row_idx").collect()} == set(range(25))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_lines_no_rows(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n\n")
    assert readers.read_sessions(spark, str(tmp_path / "none.jsonl")).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.73, 1.0])
def test_quantiles_equal_percentile(spark, q):
    rng = random.Random(2)
    rows = [("one", 4.0), ("none", None), ("same", 2.5), ("same", 2.5), ("two", 1.0), ("two", -3.0)]
    rows += [("large", rng.gauss(0, 1) ** 5 if i % 3 else 0.125) for i in range(3000)] + [("large", None), ("ties", 1.0)] + [("ties", float(i % 7)) for i in range(500)]
    rows += [("wide", float(2**i)) for i in range(-200, 200)] + [("one", float("nan"))]
    frame = spark.createDataFrame(rows, "experiment string, x double").repartition(3)
    wanted = {r.experiment: (r.p, r.n) for r in frame.where("x is not null and not isnan(x)").groupBy("experiment").agg(F.percentile("x", q).alias("p"), F.count("x").alias("n")).collect()}
    found = {r.experiment: (r.quantile, r.n) for r in exact_quantile(frame, ["experiment"], "x", q, bins=4, most=20).collect()}
    assert set(found) == set(wanted) == {"one", "same", "two", "large", "ties", "wide"}
    for k, (value, n) in wanted.items():
        assert found[k] == (pytest.approx(value, rel=1e-12), n)


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([("a", None)], "experiment string, x double")
    assert exact_quantile(frame, ["experiment"], "x", 0.5).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        exact_quantile(frame, ["experiment"], "x", 1.5)


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from choicegrid.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = spark.createDataFrame([("hot", i) for i in range(100)] + [(f"k{i}", i) for i in range(20)] + [("alone", 1)], "k string, v int")
    keyed = rows.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    found = join_keyed(rows, keyed, ["k"], "n")
    assert sorted(map(tuple, found.collect())) == sorted([("hot", i, 0) for i in range(100)] + [(f"k{i}", i, i) for i in range(20)])


def test_codes_with_suffixes_are_no_numbers(spark):
    """`1d` is a text: it isn't counted among the answers from 0 on, so two choices don't fit three such rows."""
    choices = spark.createDataFrame([("e", "p", i, x) for i, x in enumerate("AB")], "experiment string, participant string, choice_index int, human_choice string")
    table = lambda *values: spark.createDataFrame([("e", "p", i, v, None, "b") for i, v in enumerate(values)], "experiment string, participant string, row_idx long, value string, forced int, block string")
    assert canonical.align_sessions(choices, table("1", "1d", "-1")).count() == 0
    assert {(r.choice_index, r.code) for r in canonical.align_sessions(choices, table("1", "2_0", "-1")).collect()} == {(0, "1"), (1, "20")}


def test_alignment_and_frequencies_read_rows_once(spark):
    """Choices, table rows and weighted choices are scanned once each, and neither keys nor odd codes change what comes out."""
    choices = spark.createDataFrame(
        [("e", p, i, label) for p in "1234" for i, label in enumerate("xyx")] + [("e", None, 0, "x"), ("e", "5", 0, "x")], "experiment string, participant string, choice_index int, human_choice string"
    )
    nan, inf = float("nan"), float("inf")
    kinds = {"1": [(2.0, None), (-0.0, None), (1.5, None)], "2": [(7.0, 1), (1.0, 0), (nan, 0), (inf, 0)], "3": [(1.0, None), (-1.0, None), (None, None), (1e20, None), (0.0, None)], "4": [(1.0, 0)] * 5}
    table = spark.createDataFrame(
        [("e", p, i, v, f, None if i == 0 else "b") for p, rows in kinds.items() for i, (v, f) in enumerate(rows)] + [("e", None, 0, 1.0, 0, "b"), ("e", "6", 0, 1.0, 0, "b")],
        "experiment string, participant string, row_idx int, value double, forced int, block string",
    )
    aligned = canonical.align_sessions(choices, table)
    reads = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert reads(aligned) == 2
    assert {tuple(r)[1:] for r in aligned.collect()} == {
        ("1", 0, None, "2", "x", "raw"), ("1", 1, "b", "0", "y", "raw"), ("1", 2, "b", "1.5", "x", "raw"), ("2", 0, "b", "1", "x", "forced==0"), ("2", 2, "b", "Infinity", "x", "forced==0"),
        ("3", 0, None, "1", "x", "code>=0"), ("3", 1, "b", "100000000000000000000", "y", "code>=0"), ("3", 2, "b", "0", "x", "code>=0"),
    }
    as_text = canonical.align_sessions(choices, table.withColumn("value", F.col("value").cast("string")))
    assert sorted(map(str, as_text.collect())) == sorted(map(str, aligned.collect()))
    weighted = spark.createDataFrame(
        [("e", "1", 0, "a", 0.5), ("e", "1", 0, "b", 0.5), ("e", "1", 2, "a", 1.0), ("e", "1", None, None, 1.0), (None, "1", 0, "a", 1.0)], "experiment string, participant string, choice_index int, code string, w double"
    )
    shares = readouts.session_frequencies(weighted, "code", "w")
    assert reads(shares) == 1
    assert {(r.participant, r.code, r.share) for r in shares.collect()} == {("1", "a", 0.75), ("1", "b", 0.25), ("1", None, 0.5)}
