import json

import pytest
from pyspark.sql import functions as F

from choicegrid import catalog
from choicegrid.operators import canonical, integrity
from choicegrid.sources import readers, writers
from choicegrid.streaming import sessions as live

KEYS = ["experiment", "participant", "choice_index"]


def children(spark, rows):
    return spark.createDataFrame(rows, "shard int, row_idx long, experiment string, participant string, choice_index int, token_index int, rank int, token string")


def outcomes(frame):
    return {(r.key.split("\x1f")[2], r.outcome): r.n for r in frame.collect()}


def test_occurrences(spark):
    parents = spark.createDataFrame([("a", "p", 0, 2), ("a", "p", 1, 2)], "experiment string, participant string, choice_index int, expected int")
    c = lambda i, choice, rank, token="t": (0, i, "a", "p", choice, 0, rank, token)
    rows = [c(0, 0, 0), c(1, 0, 1), c(2, 1, 0), c(3, 0, 0), c(4, 0, 1), c(5, 1, 0), c(6, 1, 1), c(7, 9, 0)]
    found = outcomes(integrity.merge_occurrences(children(spark, rows), parents, KEYS, ["token_index", "rank"]))
    assert found == {("0", "kept"): 2, ("0", "replay"): 2, ("1", "incomplete"): 1, ("1", "kept"): 2, ("9", "orphan"): 1}
    with pytest.raises(Exception, match="differs"):
        integrity.merge_occurrences(children(spark, [*rows, c(8, 0, 0, "u"), c(9, 0, 1)]), parents, KEYS, ["token_index", "rank"]).collect()


def test_every_choice_is_a_parent(spark):
    sf, made = "/root/testdata/sf0.001", catalog.queries()
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()
    lost = sum(r.event_id % 23 == 0 for r in events)
    merged = {r.outcome: r.parents for r in made["occurrence_merge"](spark, sf).collect()}
    assert (merged["kept"], merged["orphan"]) == (len(events) - lost, lost)
    assert made["all_orphan_children"](spark, sf).select(*KEYS).distinct().count() == lost
    assert made["all_child_completeness"](spark, sf).count() == sum(r.event_id % 17 == 0 and r.event_id % 23 != 0 for r in events)


def test_merge_predictions(spark):
    kind = "shard int, row_idx long, experiment string, participant string, choice_index int, x string"
    same = spark.createDataFrame([(0, 0, "a", "p", 0, "u"), (0, 5, "a", "p", 0, "u")], kind)
    row = integrity.merge_predictions(same, KEYS, ["x"]).first()
    assert (row.copies, row.x) == (2, "u")
    for bad in [(1, 5, "a", "p", 0, "u"), (0, 5, "a", "p", 0, "v")]:
        with pytest.raises(Exception, match="shards|differs"):
            integrity.merge_predictions(same.union(spark.createDataFrame([bad], kind)), KEYS, ["x"]).collect()


def test_alignment_and_dictionary(spark):
    choices = spark.createDataFrame([("a", "1", i, x) for i, x in enumerate("JKJ")] + [("a", "2", i, x) for i, x in enumerate("JJ")], "experiment string, participant string, choice_index int, human_choice string")
    table = spark.createDataFrame(
        [("a", "1", i, v, f, "0") for i, (v, f) in enumerate([(0.0, 0), (1.0, 1), (1.0, 0), (0.0, 0)])] + [("a", "2", i, v, 0, "0") for i, v in enumerate([0.0, -1.0, 0.0])],
        "experiment string, participant string, row_idx int, value double, forced int, block string",
    )
    aligned = canonical.align_sessions(choices, table)
    assert sorted((r.participant, r.choice_index, r.code, r.rule) for r in aligned.collect()) == [
        ("1", 0, "0", "forced==0"), ("1", 1, "1", "forced==0"), ("1", 2, "0", "forced==0"), ("2", 0, "0", "code>=0"), ("2", 1, "0", "code>=0"),
    ]
    offered = spark.createDataFrame([("a", p, x) for p in "12" for x in "JK"], "experiment string, participant string, option string")
    codes = {(r.participant, r.label, r.code, r.source) for r in canonical.label_map(aligned, offered).collect()}
    assert codes == {("1", "J", "0", "pressed"), ("1", "K", "1", "pressed"), ("2", "J", "0", "pressed"), ("2", "K", "1", "elimination")}


def test_readers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"experiment": "collsiöö", "participant": 7, "text": "a"}\n', encoding="utf-8")
    assert readers.read_sessions(spark, str(tmp_path / "s.jsonl")).first().participant == "7"
    (tmp_path / "p.csv").write_text('condition,experiment,participant,choice_index,nll,raw_generation\nfull,a,1,0,0.5," NA"\nfull,a,1,1,0.5,"x\ny"\nw0,a,1,1,0.5,\n')
    rows = readers.read_predictions(spark, str(tmp_path / "p.csv"), ["choice_index", "nll", "raw_generation"], "full").collect()
    assert [r.raw_generation for r in rows] == [" NA", "x\ny"]
    (tmp_path / "n.csv").write_text("condition,nll\nfull,nan\n")
    with pytest.raises(Exception, match="finite"):
        readers.read_predictions(spark, str(tmp_path / "n.csv"), ["nll"]).collect()
    with pytest.raises(ValueError, match="lacks"):
        readers.read_scores(spark, str(tmp_path / "n.csv"))


def test_receipts_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 0, "full"), ("a", "1", 0, "w0"), ("b", "2", 0, "full")], "experiment string, participant string, choice_index int, condition string")
    made = writers.receipts(rows)
    assert integrity.commit_violations(made, rows).count() == 0
    assert integrity.commit_violations(made.where("experiment = 'a'"), rows).first().rule == "no_commit"
    assert [r.experiment for r in readers.pending_sessions(rows, made.where("experiment = 'a'")).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    from choicegrid.operators import baselines

    rows = [("a", str(p), i, "ABCA"[(i * p) % 4]) for p in (1, 2, 3) for i in range(9)]
    kind = "experiment string, participant string, choice_index long, human_choice string"
    for k, part in enumerate((rows[::2], rows[1::2])):
        (tmp_path / f"in{k}").mkdir()
    (tmp_path / "in").mkdir()
    frame = spark.createDataFrame([r for r in rows if "ABC"[0] <= r[3]], kind)
    frame.where("choice_index < 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame.where("choice_index >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # 3 and 4 come again
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scored = live.online_baselines(stream, 3).withColumn("condition", F.lit("full"))
    query = live.ledger_sink(scored, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(*[str(p) for p in (tmp_path / "out").glob("batch=*/predictions")])
    assert got.count() == got.dropDuplicates(["participant", "choice_index"]).count() == len(rows)
    full = baselines.online(frame)
    sizes = {p: len({r[3] for r in rows if r[1] == p}) for p in "123"}
    for r in full.where("choice_index > 0").join(got.withColumnRenamed("bigram", "b").select("participant", "choice_index", "b"), ["participant", "choice_index"]).collect():
        if sizes[r.participant] == 3:
            assert abs(r.bigram - r.b) < 1e-9
    assert json.loads(writers.receipts(got).select(F.to_json("conditions").alias("c")).first().c) == {"full": 9}
