"""Selections by a tokenizer, supervised data sets, state that ends, distributions with nulls: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from choicegrid.functions.supervision import IGNORE
from choicegrid.operators import protocol, readouts, scoring, training_set
from choicegrid.streaming import sessions as live

KIND = "experiment string, participant string, text string"


def characters(pairs=(), bos=None):
    """Characters as tokens, some pairs of them as one."""

    def make():
        def encode(text):
            out, at = [], 0
            while at < len(text):
                n = 2 if text[at : at + 2] in pairs else 1
                out.append((1000 + pairs.index(text[at : at + 2]) if n == 2 else ord(text[at]), at, at + n))
                at += n
            return out

        return scoring.Model(encode, chr, lambda requests: [], bos)

    return make


def test_selection_by_tokens(spark):
    sessions = spark.createDataFrame([("e", "1", "ab<<cd>>x<<e>>"), ("e", "2", "no marks"), ("e", "3", "<<é😀>>"), ("e", "4", None)], KIND)
    rows = {(r.participant, r.choice_index): (r.first_token, r.num_tokens) for r in scoring.choice_tokens(sessions, characters()).collect()}
    assert rows == {("1", 0): (4, 2), ("1", 1): (11, 1), ("3", 0): (2, 2)}
    merged = {(r.participant, r.choice_index): (r.first_token, r.num_tokens) for r in scoring.choice_tokens(sessions, characters(("<c",), bos=7)).collect()}
    # the pair across the mark is the choice's first token
    assert merged[("1", 0)] == (4, 2) and merged[("3", 0)] == (3, 2)
    one = scoring.choice_tokens(sessions.where("participant = '1'"), characters())
    kept = lambda n: [r.choice_index for r in protocol.within_cutoff(one, n).collect()]
    assert kept(4) == [] and kept(6) == [0] and kept(11) == [0] and sorted(kept(12)) == [0, 1]
    with pytest.raises(Exception, match="splits a choice"):
        kept(5)
    with pytest.raises(Exception, match="no tokens"):
        scoring.choice_tokens(spark.createDataFrame([("e", "1", "a<<>>")], KIND), characters()).collect()


@pytest.mark.parametrize("side", ["head", "tail"])
def test_supervised_sets(spark, side):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", "<<x>>", "<<long y>>", "é", "😀", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    sessions = spark.createDataFrame([("e", str(i), t) for i, t in enumerate(texts)] + [("e", "none", None)], KIND)
    make = characters(("bc", "x>"))
    found = {r.participant: (list(r.ids), list(r.labels)) for r in training_set.labelled(sessions, make, 25, side).collect()}
    wanted, encode = {}, make().encode
    for i, text in enumerate(texts):
        import re

        inside = [m.span(1) for m in re.finditer("(?s)<<(.*?)>>", text)]
        tokens = encode(text)
        labels = [k if any(a < e and b > s for s, e in inside) else IGNORE for k, a, b in tokens]
        ids = [k for k, _, _ in tokens]
        ids, labels = (ids[:25], labels[:25]) if side == "head" else (ids[-25:], labels[-25:])
        if any(x != IGNORE for x in labels):
            wanted[str(i)] = (ids, labels)
    assert found == wanted and 20 < len(found) < 61
    train, test = training_set.supervised_set(sessions, make, 25, side, 0.3, 4)
    names = [{r.participant for r in part.collect()} for part in (train, test)]
    assert names[0] | names[1] == set(wanted) and not names[0] & names[1] and names[1]


def test_batches_have_their_own_width(spark):
    rng = random.Random(5)
    lists = [[rng.randint(1, 9) for _ in range(rng.randint(1, 12))] for _ in range(53)]
    rows = spark.createDataFrame([("ab"[i > 30], i, x, [IGNORE, *x[1:]]) for i, x in enumerate(lists)], "task string, n int, ids array<int>, labels array<int>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for by in ([], ["task"]):
            made = training_set.padded_batches(rows, 8, 0, by).orderBy("n").collect()
            at, batch = 0, 0
            while at < len(lists):
                end = min(at + 8, 31 if by and at < 31 else len(lists))
                width = max(map(len, lists[at:end]))
                for r in made[at:end]:
                    x = lists[r.n]
                    pad = width - len(x)
                    assert (r.batch, r.width, r.ids, r.attention, r.labels) == (batch, width, x + [0] * pad, [1] * len(x) + [0] * pad, [IGNORE, *x[1:]] + [IGNORE] * pad)
                at, batch = end, batch + 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert training_set.padded_batches(rows.where("false"), 8, 0, []).count() == 0
    with pytest.raises(ValueError, match="positive"):
        training_set.padded_batches(rows, 0, 0, [])


STREAM = "experiment string, participant string, choice_index long, human_choice string, last boolean, said timestamp"


def arrive(spark, folder, rows):
    """Add rows to the stream's source, let it run until all is read, and say how many sessions have state."""
    source, out = str(folder / "in"), str(folder / "out")
    spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(source)
    scored = live.online_baselines(spark.readStream.schema(STREAM).parquet(source), 2, time="said", end="last", replay_ms=60_000, idle_ms=7_200_000)
    query = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_ends(spark, tmp_path):
    """After a session's end marker only its length is kept, after the time for replays nothing, and nothing of an idle session."""
    from datetime import datetime, timedelta

    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    session = lambda p, first, n, minute, ends=False: [("e", p, i, "AB"[i % 2], ends and i == n - 1, at(minute)) for i in range(first, n)]
    spark.createDataFrame([], STREAM).write.parquet(str(tmp_path / "in"))
    assert arrive(spark, tmp_path, session("p", 0, 4, 0, True) + session("q", 0, 3, 0)) == 2
    # a replay within its time is dropped, an hour later p's state is gone and q goes on
    assert arrive(spark, tmp_path, session("p", 0, 4, 1, True)) == 2
    assert arrive(spark, tmp_path, session("q", 3, 4, 60)) == 1
    # a day later q's state is gone too
    assert arrive(spark, tmp_path, session("r", 0, 2, 1440)) == 1
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.participant, r.n, r.m) for r in rows.groupBy("participant").agg(F.count("*").alias("n"), F.countDistinct("choice_index").alias("m")).collect()} == {("p", 4, 4), ("q", 4, 4), ("r", 2, 2)}


def test_a_choice_behind_the_end_fails(spark, tmp_path):
    from datetime import datetime

    with pytest.raises(Exception, match="after the session's end|failed"):
        arrive(spark, tmp_path, [("e", "p", 0, "A", True, datetime(2024, 1, 1)), ("e", "p", 1, "B", False, datetime(2024, 1, 1))])
    with pytest.raises(ValueError, match="needs a time"):
        live.online_baselines(spark.createDataFrame([], STREAM), 2, end="last")


def test_answer_distribution_with_nulls(spark):
    choice = "experiment string, participant string, choice_index int"
    labels = ["x", "x", "y", "x"]
    predictions = spark.createDataFrame(
        [("e", p, i, 1, human, said, "scored" if p == "1" else "off") for p in "12" for i, (human, said) in enumerate(zip(labels, ["x", "y", "z", "x"] if p == "1" else ["y"] * 4))],
        f"{choice}, num_tokens int, human_choice string, pred_choice string, options_status string",
    )
    aligned = spark.createDataFrame([("e", p, i, "b", {"x": "1", "y": "2"}[h], h, "raw") for p in "12" for i, h in enumerate(labels)], f"{choice}, block string, code string, label string, rule string")
    codes = spark.createDataFrame([("e", p, "b", label, code, "pressed") for p in "12" for label, code in (("x", "1"), ("y", "2"))], "experiment string, participant string, block string, label string, code string, source string")
    from math import log

    options = spark.createDataFrame([("e", "1", i, o, log(v)) for i in range(4) for o, v in (("x", 0.5), ("y", 0.25), ("w", 0.25))], f"{choice}, option string, logprob double")
    row = readouts.answer_distribution(predictions, options, codes, aligned, draws=4000).first()
    # session 1: people .75/.25, greedy 2/3 and 1/3 of the named; session 2: greedy all y
    assert row.tvd_pred == pytest.approx(((0.75 - 2 / 3) + 0.75) / 2) and row.off_set == pytest.approx(1 / 8) and row.off_block == 0
    assert row.tvd_options == pytest.approx(0.75 - 2 / 3) and row.off_block_mass == pytest.approx(0.25)
    assert (row.human_top_pred, row.human_top_options) == (0.75, 0.75) and row.pred_top == pytest.approx((2 / 3 + 1) / 2) and row.options_top == pytest.approx(2 / 3)
    assert (row.n_participants, row.n_pred, row.n_options) == (2, 2, 1)
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (rng.binomial(4, 0.75, 200_000) / 4 for _ in range(2))
    assert row.null_pred == pytest.approx(np.abs(a - b).mean(), abs=0.01) and row.null_options == pytest.approx(np.abs(a - 0.75).mean(), abs=0.01)
    assert not {"null_pred", "null_options"} & set(readouts.answer_distribution(predictions, options, codes, aligned, draws=0).columns)


def test_window_rules_read_rows_once(spark):
    rows = spark.createDataFrame(
        [("e", "1", None, t, t, 3, t / 2, t != 1) for t in (0, 1, 2)] + [("e", "1", w, t, min(w, t), 3, t / 2, True) for w in (0, 2) for t in (0, 2)]
        + [("e", "2", None, t, t, 3, t / 2, True) for t in (0, 0, 2)] + [("e", "2", 0, 2, 1, 3, 1.0, False), ("e", "2", 9, None, 9, 4, None, True)],
        "experiment string, participant string, window int, target_index int, effective_window int, n_segments int, target_fraction double, is_anchor boolean",
    )
    found = protocol.window_violations(rows, [0, 2])
    assert {(r.participant, r.rule, r.n) for r in found.collect()} == {
        ("2", "effective_window", 1), ("2", "unknown_window", 1), ("2", "limited_off_anchor", 1), ("2", "segments_differ", 1), ("2", "segments_not_covered", 1), ("2", "anchors_not_covered", 1),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Union" not in plan


def test_options_find_codes_without_a_join_of_their_own(spark):
    """Every option is shuffled once, to its choice; its code comes with the choice, and the sums over a choice need no further shuffle."""
    choice = "experiment string, participant string, choice_index int"
    predictions = spark.createDataFrame([("e", "1", i, "off" if i == 2 else "scored") for i in range(4)], f"{choice}, options_status string")
    aligned = spark.createDataFrame([("e", "1", 0, "b", "1"), ("e", "1", 1, "c", "2"), ("e", "1", 2, "b", "1"), ("e", "1", 3, None, "1")], f"{choice}, block string, code string")
    codes = spark.createDataFrame([("e", "1", "b", "x", "1"), ("e", "1", "b", "y", "2"), ("e", "1", "c", "x", "2"), ("e", "1", "b", None, "3"), ("e", "1", None, "x", "9")], "experiment string, participant string, block string, label string, code string")
    from math import log

    options = spark.createDataFrame([("e", "1", i, o, log(v)) for i in range(4) for o, v in (("x", 0.5), ("y", 0.25), (None, 0.25))], f"{choice}, option string, logprob double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = readouts.options_readout(predictions, options, codes, aligned)
        plan = part._jdf.queryExecution().executedPlan().toString()
        rows = {(r.choice_index, r.option): (r.code, r.option_code, r.share and round(r.share, 6), round(r.off, 6)) for r in part.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {
        (0, "x"): ("1", "1", 0.666667, 0.0), (0, "y"): ("1", "2", 0.333333, 0.0), (0, None): ("1", None, None, 0.25),
        (1, "x"): ("2", "2", 1.0, 0.0), (1, "y"): ("2", None, None, 0.25), (1, None): ("2", None, None, 0.25),
        (3, "x"): ("1", None, None, 0.5), (3, "y"): ("1", None, None, 0.25), (3, None): ("1", None, None, 0.25),
    }
    assert plan.index("SortMergeJoin") < plan.index("Exchange") and "option" not in plan[plan.index("LeftOuter") :].split("\n")[0]


def test_unnamed_mass_is_the_sum_of_the_options_parts(spark):
    """Null probabilities, null options, a block without a dictionary and a choice that isn't scored among them."""
    choice = "experiment string, participant string, choice_index int"
    predictions = spark.createDataFrame([("e", "1", i, "off" if i == 2 else "scored") for i in range(8)], f"{choice}, options_status string")
    aligned = spark.createDataFrame([("e", "1", i, "c" if i == 3 else "b", "1") for i in range(7)], f"{choice}, block string, code string")
    codes = spark.createDataFrame([("e", "1", "b", "x", "1"), ("e", "1", "b", "y", "2")], "experiment string, participant string, block string, label string, code string")
    given = {0: [("x", -1.0), ("y", -2.0), ("w", -1.5)], 1: [("x", -1.0), ("y", -2.0)], 2: [("x", -1.0)], 3: [("x", -1.0), (None, -2.0)], 4: [("x", None), ("w", -1.0)], 5: [("x", None), ("w", None)], 6: [("w", None)], 7: [("x", -1.0)]}
    options = spark.createDataFrame([("e", "1", i, *o) for i, each in given.items() for o in each], f"{choice}, option string, logprob double")
    tables = predictions, options, codes, aligned
    found = {r.choice_index: r.off for r in readouts.unnamed_mass(*tables).collect()}
    from math import exp

    assert found == {0: pytest.approx(exp(-1.5) / (exp(-1) + exp(-2) + exp(-1.5))), 1: 0.0, 3: pytest.approx(1.0), 4: 1.0, 5: 0.0, 6: None}
    summed = readouts.options_readout(*tables).groupBy("choice_index").agg(F.sum("off").alias("off"))
    assert found == {r.choice_index: pytest.approx(r.off) for r in summed.collect()}


def test_options_readout_sums_without_a_window_and_deals_sessions(spark):
    """No window over the options, a choice's total found once, and sessions over all partitions where choices and table rows are paired."""
    from choicegrid.plans import readouts as plans

    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    plan = plan_of(plans.options_readout(spark, "/root/testdata/sf0.001"))
    assert "Window [sum(" not in plan and plan.index("Generate posexplode") < plan.index(" aggregate(")
    assert "REPARTITION_BY_NUM" in plan_of(plans._aligned(spark, "/root/testdata/sf0.001"))


def test_answer_distribution_sorts_no_options_for_their_choices(spark):
    """Written tables have a row per choice, and each is read without a join per column of the report."""
    choice = "experiment string, participant string, choice_index int"
    predictions = spark.createDataFrame([("e", "1", 0, 1, "x", "x", "scored")], f"{choice}, num_tokens int, human_choice string, pred_choice string, options_status string")
    aligned = spark.createDataFrame([("e", "1", 0, "b", "1")], f"{choice}, block string, code string")
    codes = spark.createDataFrame([("e", "1", "b", "x", "1"), ("e", "1", "b", "y", "2")], "experiment string, participant string, block string, label string, code string")
    options = spark.createDataFrame([("e", "1", 0, o, -1.0) for o in "xyz"], f"{choice}, option string, logprob double")
    table = readouts.answer_distribution(predictions, options, codes, aligned, draws=0)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan parquet"), plan.count("lag("), plan.count("FullOuter")) == (6, 0, 5)
    row = table.first()
    assert (row.tvd_pred, row.tvd_options, row.human_top_pred, row.pred_top, row.human_top_options, row.options_top) == (0.0, 0.5, 1.0, 1.0, 1.0, 0.5)
    assert row.off_block_mass == pytest.approx(1 / 3) and (row.n_participants, row.n_pred, row.n_options) == (1, 1, 1)


def test_readouts_meet_their_codes_by_merges(spark):
    """Choices, blocks and sessions grow with the input: none is broadcast, however few bytes their tables have on disk."""
    from choicegrid.operators import canonical
    from choicegrid.sources.files import written

    choice = "experiment string, participant string, choice_index int"
    made = lambda rows, columns: written(spark.createDataFrame(rows, columns))
    said = ["x", "z", "q", "x", "y", None, "x"]
    predictions = made([("e", "1", i, 2 if i == 6 else 1, v, "scored") for i, v in enumerate(said)] + [("e", "2", 0, 1, "x", "scored"), ("e", "3", 0, 1, "x", "scored")], f"{choice}, num_tokens int, pred_choice string, options_status string")
    blocks = ["b", "b", "b", "c", None, "b", "b"]
    aligned = made([("e", "1", i, b, "1", "x") for i, b in enumerate(blocks)] + [("e", "2", 0, "b", "1", "x")], f"{choice}, block string, code string, label string")
    codes = made([("e", "1", "b", "x", "1"), ("e", "1", "b", "y", "2"), ("e", "1", "c", "z", "3"), ("e", "1", "b", None, "4"), ("e", "1", None, "y", "9")], "experiment string, participant string, block string, label string, code string")
    options = made([("e", "1", i, o, -1.0) for i in range(7) for o in "xy"], f"{choice}, option string, logprob double")

    def final(frame):
        rows = frame.collect()
        return rows, frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    rows, plan = final(readouts.greedy_readout(predictions, codes, aligned))
    assert {(r.participant, r.choice_index): (r.block, r.code, r.pred_code, r.bucket) for r in rows} == {
        ("1", 0): ("b", "1", "1", "code"), ("1", 1): ("b", "1", None, "off_block"), ("1", 2): ("b", "1", None, "off_set"), ("1", 3): ("c", "1", None, "off_block"),
        ("1", 4): (None, "1", None, "off_block"), ("1", 5): ("b", "1", None, "off_set"), ("2", 0): ("b", "1", None, "off_set"),
    }
    assert list(rows[0].asDict()) == [*predictions.columns, "block", "code", "pred_code", "bucket"]
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    assert plan.index("Exchange") < plan.index("element_at(")  # codes are read off before rows are shuffled to their session
    for frame in (readouts.options_readout(predictions, options, codes, aligned), readouts.unnamed_mass(predictions, options, codes, aligned), readouts.answer_distribution(predictions, options, codes, aligned, draws=2)):
        assert "Broadcast" not in final(frame)[1]
    # only a task's codes by block may be
    rows, plan = final(canonical.label_map(aligned, options.select("experiment", "participant", "option")))
    assert {(r.participant, r.block, r.label, r.code) for r in rows} == {("1", "b", "x", "1"), ("1", "c", "x", "1"), ("2", "b", "x", "1")}
    assert plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan
