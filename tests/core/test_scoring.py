"""Scores by a plugged-in model, selections, checks and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicegrid.functions.scalars import missing_as_null
from choicegrid.operators import baselines, curves, metrics, protocol, readouts, sampling, scoring
from choicegrid.streaming import sessions as live

TEXT = "Rules.\n\nA <<ab>>. one\nB <<c>> <<d>>\nC <<ab>>\nend"
KIND = "experiment string, participant string, text string"
HEAD, SEGMENTS = "Rules.\n\n", ["A <<ab>>. one\n", "B <<c>> <<d>>\n", "C <<ab>>\n"]
EVERY = lambda n: F.sequence(F.lit(0), n - 1)
V = 128


def merging(pairs=(), logits=None, **more):
    """A model of characters that takes some pairs of them as one token, as tokenizers do."""

    def make():
        def encode(text):
            out, at = [], 0
            while at < len(text):
                n = 2 if text[at : at + 2] in pairs else 1
                out.append((V + pairs.index(text[at : at + 2]) if n == 2 else ord(text[at]) % V, at, at + n))
                at += n
            return out

        def plain(requests):
            return [(np.array(places)[:, None] * (np.arange(V + len(pairs))[None, :] + 1) % 97 / 9.0) for _, places in requests]

        return scoring.Model(encode, lambda k: pairs[k - V] if k >= V else chr(k), logits or plain, **more)

    return make


def scores_of(spark, make, windows=(0, 1, 9, "full"), budget=4096, top_k=2, max_options=4, text=TEXT):
    sessions = spark.createDataFrame([("a", "1", text), ("a", "2", "no marks"), ("a", "3", text)], KIND)
    prepared = scoring.prepare(scoring.window_cells(sessions, list(windows), EVERY), make, max_options)
    return scoring.choice_scores(scoring.score(prepared, make, budget, top_k))


def plain_scores(make, windows, top_k=2):
    """By plain loops over one session's text: one text per choice and window, tokens by brute force."""
    import re

    model = make()
    spans = [len(re.findall("<<.*?>>", s)) for s in SEGMENTS]
    for t in range(len(SEGMENTS)):
        for w in windows:
            start = 0 if w == "full" else max(t - w, 0)
            text = TEXT if w == "full" else HEAD + "".join(SEGMENTS[start : t + 1])
            marks = list(re.finditer("<<(.*?)>>", text))[sum(spans[start:t]) :][: spans[t]]
            encoded = model.encode(text)
            for k, m in enumerate(marks):
                own = [i for i, (_, a, b) in enumerate(encoded) if a < m.end(1) and b > m.start(1)]
                rows = next(iter(model.logits([([e[0] for e in encoded], own)])))
                lost, first = 0.0, None
                for i, row in zip(own, rows):
                    lp = [x - math.log(sum(math.exp(y) for y in row)) for x in row]
                    lost -= lp[encoded[i][0]]
                    first = first or lp
                best = first.index(max(first))
                said = model.decode(best)
                top = sorted(range(len(first)), key=lambda j: (-first[j], j))[:top_k]
                yield ("full" if w == "full" else f"w{w}", sum(spans[:t]) + k), (t, m[1], round(lost, 9), len(own), best, said, said in {"ab", "c", "d"}, top)


@pytest.mark.parametrize("pairs", [(), ("ab", "<<"), ("<c", ">>", "d>")])
@pytest.mark.parametrize("budget", [1, 60, 4096])
def test_scores_equal_plain_loops(spark, budget, pairs):
    make = merging(pairs)
    wanted = dict(plain_scores(make, [0, 1, 9, "full"]))
    rows = scores_of(spark, make, budget=budget).collect()
    assert len(rows) == 2 * len(wanted) == 32
    for r in rows:
        top = [t.token_id for t in r.topk if t.token_index == 0]
        assert (r.target_index, r.human_choice, round(r.nll, 9), r.num_tokens, r.pred_token_id, r.pred_choice, r.format_ok, top) == wanted[r.condition, r.choice_index]
        assert r.effective_window == (r.target_index if r.window is None else min(r.window, r.target_index))
    assert {r.choice_index for r in rows} == {0, 1, 2, 3}


def test_options_and_their_guard(spark):
    status = lambda make, **more: {(r.human_choice, r.options_status, len(r.options)) for r in scores_of(spark, make, **more).collect()}
    assert status(merging(), max_options=0) == {("ab", "off", 0), ("c", "off", 0), ("d", "off", 0)}
    assert status(merging(), max_options=2) == {(c, "too_many_options", 0) for c in ("ab", "c", "d")}
    assert status(merging()) == {(c, "multi_token_option", 0) for c in ("ab", "c", "d")}
    assert status(merging(("ab",))) == {(c, "scored", 3) for c in ("ab", "c", "d")}
    assert status(merging(("ab", "<c"))) == {(c, "tokenization_mismatch", 0) for c in ("ab", "c", "d")}
    # the text holds another token than the option's own: only that choice is left out
    assert status(merging(("ab", "d>"))) == {("ab", "scored", 3), ("c", "scored", 3), ("d", "tokenization_mismatch", 0)}
    for r in scores_of(spark, merging(("ab",))).collect():
        assert abs(r.legal_mass - sum(math.exp(o.logprob) for o in r.options)) < 1e-12 and [o.option for o in r.options if o.is_human] == [r.human_choice]


def test_only_whole_labels_are_well_formed(spark):
    a = lambda requests: [[np.eye(V)[ord("a")] for _ in places] for _, places in requests]
    assert {(r.pred_choice, r.format_ok) for r in scores_of(spark, merging(logits=a)).collect()} == {("a", False)}
    c = lambda requests: [[np.eye(V)[ord("c")] for _ in places] for _, places in requests]
    assert {(r.pred_choice, r.format_ok) for r in scores_of(spark, merging(logits=c)).collect()} == {("c", True)}


def test_equal_cells_are_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)
    make = merging()

    def counting():
        model = make()

        def logits(requests):
            asked.add(len(requests))
            return model.logits(requests)

        return scoring.Model(model.encode, model.decode, logits)

    sessions = spark.createDataFrame([("a", "1", TEXT)], KIND)
    cells = scoring.window_cells(sessions, [0, 1, 2, 100], EVERY)
    assert cells.count() == 6
    # four windows, four choices
    assert len(scoring.choice_scores(scoring.score(scoring.prepare(cells, counting), counting)).collect()) == 16 and asked.value == 6


def test_batches_go_over_arrow_batches(spark):
    """The batches of a partition are those of the plain longest-first packing, however rows arrive."""
    texts = [f"R\n\n{'x' * (i * 7 % 50)} <<a>>\n" for i in range(60)]
    sessions = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], KIND)
    batches = spark.sparkContext.accumulator(0)
    make = merging()

    def counting():
        model = make()

        def logits(requests):
            batches.add(1)
            assert len(requests) == 1 or max(len(ids) for ids, _ in requests) * len(requests) <= 200
            return model.logits(requests)

        return scoring.Model(model.encode, model.decode, logits)

    prepared = scoring.prepare(scoring.window_cells(sessions, ["full"], EVERY).coalesce(1), make)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert scoring.score(prepared, counting, 200).count() == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lengths, held, plain = sorted((len(t) for t in texts), reverse=True), [], 0
    for n in lengths:
        if held and held[0] * (len(held) + 1) > 200:
            plain, held = plain + 1, []
        held.append(n)
    assert batches.value == plain + 1


def test_what_a_model_must_not_do(spark):
    for make, said in (
        (merging(logits=lambda requests: [[np.full(V, np.nan)] * len(p) for _, p in requests]), "finite"),
        (merging(logits=lambda requests: [[] for _ in requests]), "every place"),
        (merging(most_tokens=20), "takes 20"),
    ):
        with pytest.raises(Exception, match=said):
            scores_of(spark, make).collect()
    with pytest.raises(Exception, match="no tokens"):
        scores_of(spark, merging(), text="R\n\nA <<>>\n").collect()
    with pytest.raises(Exception, match="aren't those"):
        scores_of(spark, merging(), text="R\n\nA <<x\ny>>\nB <<z>>\n").collect()


def test_top_tokens_of_large_vocabularies():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, size=(5, 6000)).astype(float)  # many ties
    assert scoring.likeliest(x, 7).tolist() == [sorted(range(6000), key=lambda j: (-row[j], j))[:7] for row in x]
    assert scoring.likeliest(x[:, :9], 20).shape == (5, 9) and scoring.likeliest(x, 0).shape == (5, 0)


def test_a_first_token_needs_one_before_it(spark):
    assert scoring.overlapping([(5, 0, 3), (6, 3, 3), (7, 3, 4)], [(1, 2), (2, 4)]) == [[], [2]]
    assert scoring.overlapping([(1, 0, 0), (5, 0, 3), (7, 3, 4)], [(1, 2)]) == [[1]]


def test_tables_of_one_pass(spark, tmp_path):
    from choicegrid.operators import integrity
    from choicegrid.sources.writers import shape_scores, write_tables

    make, keys = merging(("ab",)), [*scoring.SESSION, *scoring.SCORED]
    scores_of(spark, make).write.parquet(str(tmp_path / "nested"))
    tables = shape_scores(spark.read.parquet(str(tmp_path / "nested")), {"model": "m"}, keys)
    write_tables(tables, str(tmp_path / "out"))
    parents, topk, options = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("predictions", "pred_topk", "pred_options"))
    assert parents.count() == 32 and topk.count() == parents.agg(F.sum("num_tokens")).first()[0] * 2 and options.count() == 32 * 3
    own = [*scoring.SESSION, "condition", "choice_index"]
    for rows, expected, suffix in ((topk, "num_tokens * 2", ["token_index", "rank"]), (options, "k_options", ["option"])):
        assert integrity.orphans(rows, parents, own).count() == 0
        assert integrity.incomplete(rows, parents.withColumn("expected", F.expr(expected).cast("long")), own, suffix).count() == 0
    assert {c for c in topk.columns} == {"model", *keys, "token_index", "rank", "token_id", "token", "logprob"}


def choices(spark, labels, extra=()):
    return spark.createDataFrame([("a", "p", i, x) for i, x in enumerate(labels)] + list(extra), "experiment string, participant string, choice_index int, human_choice string")


def test_guesses(spark):
    rows = choices(spark, "ABACAB")
    said = {rule: [r.guess for r in baselines.guesses(rows, rule).orderBy("choice_index").collect()] for rule in ("base_rate", "sticky", "bigram")}
    assert said == {"base_rate": list("AAAAA"), "sticky": list("ABACA"), "bigram": list("AABAB")}
    one = baselines.prequential(choices(spark, "A")).first()
    assert one.uniform == 1.0 and one.sticky is None
    with pytest.raises(ValueError, match="rule"):
        baselines.guesses(rows, "x")


def test_labels_beyond_the_support_fail(spark):
    support = spark.createDataFrame([("a", "A")], "experiment string, label string")
    with pytest.raises(Exception, match="beyond the support"):
        baselines.population(choices(spark, "AA"), choices(spark, "AB"), support).collect()


def test_repeated_keys_fail(spark):
    rows = spark.createDataFrame([("a", "p", 0, 1.0), ("a", "p", 0, 2.0)], "experiment string, participant string, choice_index int, nll double")
    once = rows.where("nll < 2")
    for a, b in ((rows, once), (once, rows)):
        with pytest.raises(Exception, match="repeated"):
            metrics.matched_ratio(a, b, "nll").collect()
    scored = once.select("experiment", "participant", "choice_index", F.col("nll").alias("uniform"))
    with pytest.raises(Exception, match="repeated"):
        curves.with_baselines(rows, scored, ["uniform"]).collect()
    with pytest.raises(Exception, match="repeated"):
        curves.anchored(once.withColumns({"window": F.lit(0), "target_index": F.lit(0), "effective_window": F.lit(0)}), rows).collect()


def test_selections(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sampling.nonempty(rows) is rows
    with pytest.raises(ValueError, match="no sessions"):
        sampling.nonempty(rows.where("false"), "sessions")
    texts = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(["x <<y>>\n", "none", "x <<>>", "", None, "x <<open"])], "experiment string, participant string, text string")
    assert {r.participant: r.problem for r in sampling.unreadable(texts).collect()} == {"1": "unmarked", "2": "empty_mark", "3": "unmarked", "4": "unmarked", "5": "unmarked"}
    assert sampling.lossy_segments(texts).count() == 0
    many = spark.createDataFrame([(str(i),) for i in range(2000)], "k string")
    train, test = sampling.split_train_eval(many, ["k"], 0.25, 3)
    assert train.count() + test.count() == 2000 and 400 < test.count() < 600 and train.join(test, "k").count() == 0
    again = sampling.split_train_eval(many.repartition(7), ["k"], 0.25, 3)[1]
    assert {r.k for r in again.collect()} == {r.k for r in test.collect()}


def test_missing_values_are_skipped(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert rows.agg(F.avg(missing_as_null(F.col("x"))).alias("m")).first().m == 1.0


def test_contracts_and_steps(spark):
    same = protocol.run_contract([{"k": 1, "shard": 1}, {"k": 1, "shard": 0}])
    assert same == {"k": 1}
    for bad, said in (([], "no manifests"), ([{"k": 1, "shard": 0}, {"k": 2, "shard": 1}], "differ"), ([{"k": 1, "shard": 0}, {"k": 1, "shard": 2}], "shards")):
        with pytest.raises(ValueError, match=said):
            protocol.run_contract(bad)
    paths = spark.createDataFrame([(f"r/checkpoint-{k}",) for k in (9, 100, 20)] + [("r/checkpoint-x",), ("r/checkpoint-999-old",)], "path string")
    assert tuple(protocol.latest_step(paths).first()) == ("r/checkpoint-100", 100)
    assert [r.n for r in protocol.longest_first(spark.createDataFrame([(i,) for i in (1, 3, 2)], "n int").coalesce(1), "n").collect()] == [3, 2, 1]
    ours = spark.createDataFrame([("a", 1.0)], "experiment string, task_nll double")
    with pytest.raises(Exception, match="no value for"):
        protocol.published_gaps(ours, spark.createDataFrame([("b", 1.0)], "experiment string, task_nll double")).collect()
    counts = protocol.shard_counts(choices(spark, "AB"), 2).first()
    assert (counts.sessions, counts.expected, counts.complete) == (1, 2, False)


def test_resampling_null_by_numpy(spark):
    rows = [("a", "p", "x", 0.75, 8), ("a", "p", "y", 0.25, 8), ("a", "q", "x", 1.0, 3)]
    human = spark.createDataFrame(rows, "experiment string, participant string, code string, share double, n_choices int")
    found = {r.participant: r.null for r in readouts.resampling_null(human, draws=2000).collect()}
    rng = np.random.default_rng(1)
    a, b = (rng.multinomial(8, [0.75, 0.25], size=200_000) / 8 for _ in range(2))
    assert found["q"] == 0.0 and abs(found["p"] - np.abs(a - b).sum(axis=1).mean() / 2) < 0.01
    one = {r.participant: r.null for r in readouts.resampling_null(human, draws=2000, two_sided=False).collect()}
    assert abs(one["p"] - np.abs(a - [0.75, 0.25]).sum(axis=1).mean() / 2) < 0.01
    assert found == {r.participant: r.null for r in readouts.resampling_null(human.repartition(5), draws=2000).collect()}


def test_running_counts_of_a_stream(spark, tmp_path):
    rows = choices(spark, "ABAC")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.label: r.n for r in spark.table("running").collect()} == {"A": 2, "B": 1, "C": 1}


def test_a_gap_in_a_stream_fails(spark, tmp_path):
    rows = choices(spark, "ABAC").withColumn("choice_index", F.col("choice_index").cast("long"))
    rows.where("choice_index <> 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.online_baselines(stream, 3).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="hasn't come|failed"):
        query.awaitTermination(120)


def test_receipts_of_batches_add_up(spark):
    from choicegrid.sources.writers import receipts

    rows = choices(spark, "ABAC").withColumn("condition", F.lit("full"))
    parts = receipts(rows.where("choice_index < 1")).unionByName(receipts(rows.where("choice_index >= 1")))
    total, whole = live.total_receipts(parts).first(), receipts(rows).first()
    assert total.asDict() == whole.asDict()


def test_a_run_that_breaks_and_goes_on(spark, tmp_path):
    """Killed in the third wave and resumed: the tables equal those of a run in one go, nothing is asked twice that has a receipt."""
    from choicegrid.operators import integrity, runs
    from choicegrid.sources import files

    keys, path = [*scoring.SESSION, *scoring.SCORED], str(tmp_path / "run")
    sessions = spark.createDataFrame([("a", str(i), TEXT) for i in range(12)] + [("a", "none", "no marks")], KIND)
    broken, asked = tmp_path / "broken", spark.sparkContext.accumulator(0)
    flag = str(broken)

    def failing():
        import os

        model = merging(("ab",))()

        def logits(requests):
            if os.path.exists(flag):
                raise RuntimeError("the host is gone")
            asked.add(len(requests))
            return model.logits(requests)

        return scoring.Model(model.encode, model.decode, logits)

    def nested(rows):
        prepared = scoring.prepare(scoring.window_cells(rows, [0, "full"], EVERY), failing, 4)
        return scoring.choice_scores(scoring.score(prepared, failing, top_k=2))

    assert runs.score_run(sessions, path, nested, keys, {"model": "m"}, waves=5, most_waves=2) == 2
    first = {r.participant for r in runs.commits(spark, path).collect()}
    assert 0 < len(first) < 13 and asked.value == 4 * len(first - {"none"})
    with pytest.raises(FileExistsError):
        runs.score_run(sessions, path, nested, keys, waves=5)
    broken.touch()
    with pytest.raises(Exception, match="gone"):
        runs.score_run(sessions, path, nested, keys, {"model": "m"}, waves=5, resume=True)
    # a wave whose tables are written and whose receipts aren't: readers don't see it, the next start removes it
    runs.finished(spark, path, "predictions").write.parquet(f"{path}/predictions/attempt-lost")
    assert {r.participant for r in runs.finished(spark, path, "predictions").select("participant").distinct().collect()} == first - {"none"}
    broken.unlink()
    asked_before = asked.value
    assert runs.score_run(sessions, path, nested, keys, {"model": "m"}, waves=5, resume=True) == 3
    assert asked.value - asked_before == 4 * (12 - len(first - {"none"}))
    assert not files.exists(spark, f"{path}/predictions/attempt-lost") and not [n for n in files.listed(spark, path) if n.startswith("_")]
    assert runs.score_run(sessions, path, nested, keys, waves=5, resume=True) == 0

    whole = str(tmp_path / "whole")
    runs.score_run(sessions, whole, nested, keys, {"model": "m"}, waves=1)
    for table in runs.TABLES:
        ours, theirs = (sorted(map(str, runs.finished(spark, p, table).collect())) for p in (path, whole))
        assert ours == theirs and len(ours) > 12
    done = runs.commits(spark, path)
    assert {r.participant: r.status for r in done.collect()} == {"none": "empty"} | {str(i): "complete" for i in range(12)}
    assert integrity.commit_violations(done.where("status = 'complete'"), runs.finished(spark, path, "predictions")).count() == 0


def test_a_run_of_nothing(spark, tmp_path):
    from choicegrid.operators import runs

    sessions = spark.createDataFrame([], KIND)
    assert runs.score_run(sessions, str(tmp_path / "r"), lambda rows: rows, ["experiment"]) == 0
    assert runs.commits(spark, str(tmp_path / "r")) is None and runs.finished(spark, str(tmp_path / "r"), "predictions") is None


def test_tasks_hold_slices_of_batches(spark, monkeypatch):
    """Of a batch of 1,000 texts no more than a slice becomes Python values before the first rows leave the task."""
    import pyarrow as pa

    from choicegrid.operators import training_set

    rows = spark.createDataFrame([("a", str(k), TEXT) for k in range(1000)], KIND)
    kind, tasks = type(rows), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: (tasks.append((f, self)), plain(self, f, *a, **k))[1])
    asked = []

    def counting():
        model = merging(("ab",))()
        return scoring.Model(lambda text: (asked.append(text), model.encode(text))[1], model.decode, model.logits)

    scoring.prepare(scoring.window_cells(rows, ["full"], EVERY), counting)
    training_set.supervised_set(rows, counting, 50)
    assert len(tasks) > 1
    for task, source in tasks[:2]:
        batch = pa.Table.from_batches(source.toArrow().to_batches()).combine_chunks().to_batches()
        assert [b.num_rows for b in batch] == [1000]
        asked.clear()
        first = next(iter(task(iter(batch))))
        assert first.num_rows == scoring.ROWS and len(asked) <= scoring.ROWS + 10


def test_nested_values():
    import pyarrow as pa

    rows = [[[1, 2], []], None, [], [[3], [4, 5]], [[6]]]
    array = pa.array(rows, pa.list_(pa.list_(pa.int32())))
    assert scoring.values_of(array) == rows and scoring.values_of(array.slice(1, 3)) == rows[1:4] and scoring.values_of(array[:0]) == []
    words = pa.array([["a", None], None, ["b"]], pa.list_(pa.string()))
    assert scoring.values_of(words.slice(1)) == [None, ["b"]] and scoring.values_of(words) == [["a", None], None, ["b"]]


def test_nulls_are_drawn_without_a_table_per_session(spark):
    human = spark.createDataFrame([("t", "1", "a", 0.5, 4), ("t", "1", "b", 0.5, 4)], "experiment string, participant string, code string, share double, n_choices int")
    assert "InPandas" not in readouts.resampling_null(human)._jdf.queryExecution().toString()
    rng = np.random.default_rng([7, *b"t\x1f1"])
    draw = lambda: rng.multinomial(4, [0.5, 0.5], size=64) / 4
    assert readouts.resampling_null(human, seed=7).first().null == np.clip(draw() - draw(), 0, None).sum(axis=1).mean()
