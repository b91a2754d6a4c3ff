"""Merging a sharded run: what is published, and every reason not to."""

import json

import pytest

from choicegrid.operators import contract, integrity, merge
from choicegrid.sources import files, parameters, readers, writers

KINDS = {"pred_topk": merge.Child(["token_index", "rank"], "num_tokens * 2")}
HEAD = "experiment,participant,choice_index,human_choice,num_tokens,condition"
TOP = "experiment,participant,choice_index,token_index,rank,token"


def run(tmp_path, predictions=None, top=None, shards=2, manifests=None, commits=True, **more):
    """Two shards with a replayed prediction, a child cut short and whole later, and one without a parent."""
    folder = tmp_path / "run"
    folder.mkdir()
    predictions = predictions or {0: ['a,1,0,x,1,full', 'a,1,1,"y\nz",1,full', 'a,1,0,x,1,full'], 1: ["b,2,0,x,1,full"]}
    top = top or {0: ["a,1,0,0,0,t", "a,1,1,0,0,t", "a,1,1,0,1,u", "a,1,0,0,0,t", "a,1,0,0,1,u", "a,9,0,0,0,t"], 1: ["b,2,0,0,0,t", "b,2,0,0,1,u"]}
    for name, head, rows in (("predictions", HEAD, predictions), ("pred_topk", TOP, top)):
        for k, lines in rows.items():
            (folder / f"{name}.{k}.csv").write_text("\n".join([more.get("head", {}).get((name, k), head), *lines]) + "\n")
    for k in range(shards):
        (folder / f"manifest.{k}.json").write_text(json.dumps({"num_shards": shards, "top_k": 2, "shard": k, **(manifests or {}).get(k, {})}))
    if commits:
        (folder / "session_commits").mkdir()
        for e, p, n in more.get("receipts", [("a", "1", 2), ("b", "2", 1)]):
            name = files_digest(e, p) if not more.get("misnamed") else "0" * 64
            (folder / "session_commits" / f"{name}.json").write_text(json.dumps({"schema": 1, "experiment": e, "participant": p, "status": "complete", "prediction_rows": n, "conditions": {"full": n}}))
    return folder


def files_digest(experiment, participant):
    import hashlib

    return hashlib.sha256(json.dumps([experiment, participant], separators=(",", ":")).encode()).hexdigest()


def test_merge(spark, tmp_path):
    folder = run(tmp_path)
    report = {r["table"]: r for r in merge.merge_run(spark, str(folder), 2, KINDS)}
    assert report["predictions"] == {"table": "predictions", "rows": 3, "replays": 1, "incomplete": 0, "orphans": 0}
    assert report["pred_topk"] == {"table": "pred_topk", "rows": 6, "replays": 0, "incomplete": 1, "orphans": 1}
    assert sorted(r.human_choice for r in spark.read.parquet(f"{folder}/merged/predictions").collect()) == ["x", "x", "y\nz"]
    assert spark.read.parquet(f"{folder}/merged/pred_topk").count() == 6
    assert not [n for n in files.listed(spark, str(folder)) if n.startswith("_staging")]
    with pytest.raises(merge.MergeError, match="already"):
        merge.merge_run(spark, str(folder), 2, KINDS)


CASES = {
    "no manifests": ({"shards": 0}, "manifests"),
    "manifests that differ": ({"manifests": {1: {"top_k": 3}}}, "differ"),
    "a manifest lacks top_k": ({"manifests": {1: {"top_k": None}}}, "top_k"),
    "a manifest lacks a key": ({"manifests": {0: {"seed": 3}}}, "differ"),
    "one manifest is of the window suite": ({"manifests": {1: {"suite": "e3"}}}, "differ"),
    "another number of shards": ({"manifests": {0: {"num_shards": 3}, 1: {"num_shards": 3}}}, "state 3"),
    "a shard lacks": ({"predictions": {0: ["a,1,0,x,1,full"]}}, "shards"),
    "headers differ": ({"head": {("predictions", 1): HEAD.replace("human_choice", "other")}}, "headers"),
    "a replay differs": ({"predictions": {0: ["a,1,0,x,1,full", "a,1,0,y,1,full"], 1: ["b,2,0,x,1,full"]}}, "differ between"),
    "a key in two shards": ({"predictions": {0: ["a,1,0,x,1,full", "a,1,1,y,1,full"], 1: ["b,2,0,x,1,full", "a,1,0,x,1,full"]}}, "differ between"),
    "a child in another shard": ({"top": {0: ["a,1,0,0,0,t", "a,1,0,0,1,u", "a,1,1,0,0,t", "a,1,1,0,1,u", "b,2,0,0,0,t"], 1: ["b,2,0,0,0,t", "b,2,0,0,1,u"]}}, "another shard"),
    "a prediction without its rows": ({"top": {0: ["a,1,0,0,0,t", "a,1,0,0,1,u", "a,1,1,0,0,t"], 1: ["b,2,0,0,0,t", "b,2,0,0,1,u"]}}, "without all"),
    "a whole replay differs": ({"top": {0: ["a,1,0,0,0,t", "a,1,0,0,1,u", "a,1,1,0,0,t", "a,1,1,0,1,u", "a,1,0,0,0,t", "a,1,0,0,1,v"], 1: ["b,2,0,0,0,t", "b,2,0,0,1,u"]}}, "differs"),
    "a receipt of another count": ({"receipts": [("a", "1", 3), ("b", "2", 1)]}, "receipts"),
    "a receipt lacks": ({"receipts": [("a", "1", 2)]}, "receipts"),
    "a receipt with another name": ({"misnamed": True, "receipts": [("a", "1", 2)]}, "receipts"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_what_is_not_merged(spark, tmp_path, case):
    how, said = CASES[case]
    folder = run(tmp_path, **how)
    with pytest.raises(Exception, match=said):
        merge.merge_run(spark, str(folder), 2, KINDS)
    assert not files.exists(spark, f"{folder}/merged/predictions")
    assert not [n for n in files.listed(spark, str(folder)) if n.startswith("_staging")]


WINDOWS = {"suite": "e3", "windows": [0, 1, "full"], "full_condition": "full", "num_positions": 5, "position_grid": "e0-informed", "top_k": 2}
BAD = [
    ({"windows": None}, "list"), ({"windows": [0, 0, "full"]}, "repeat"), ({"windows": [0, "full", "full"]}, "repeat"), ({"windows": [-1, "full"]}, "can't be"), ({"windows": [True, "full"]}, "can't be"),
    ({"windows": [0, 1]}, "whole transcript"), ({"full_condition": "w9"}, "whole transcript"), ({"num_positions": 0}, "num_positions"), ({"num_positions": None}, "missing"),
    ({"position_grid": "odd"}, "position_grid"), ({"num_positions": 4}, "position_grid"), ({"condition_prefix": "e4"}, "condition_prefix"),
]


@pytest.mark.parametrize("change, said", BAD)
def test_window_contracts(change, said):
    of = lambda m, launcher=None: contract.contract_of([m | {"shard": 0}, m | {"shard": 1}], launcher, 2)
    assert of(WINDOWS).windows == contract.Windows((0, 1), 5, "e0-informed")
    with pytest.raises(ValueError, match=said):
        of(WINDOWS | change)


def test_launchers_and_suites():
    plain = {"top_k": 2, "seed": 1}
    of = lambda manifests, launcher=None, shards=2: contract.contract_of([m | {"shard": k} for k, m in enumerate(manifests)], launcher, shards)
    assert of([plain, plain]) == contract.Contract(2, 2, None, plain)
    assert of([], {"top_k": 3, "num_shards": 2}) == contract.Contract(3, 2)
    assert of([WINDOWS, WINDOWS], WINDOWS).windows.windows == (0, 1)
    for manifests, launcher, said in (
        ([], None, "no manifests"), ([plain, plain], {}, "top_k is missing"), ([{}, {}], None, "top_k is missing"), ([plain, plain], {"top_k": 3}, "top_k differs"), ([{"top_k": -1}] * 2, None, "can't be"),
        ([plain], None, "manifests of 1"), ([plain, plain], {"top_k": 2, "num_shards": 3}, "state 3"), ([plain, plain], WINDOWS, "missing from"), ([WINDOWS, WINDOWS], {"top_k": 2}, "missing from"),
        ([WINDOWS, WINDOWS], WINDOWS | {"windows": [0, 2, "full"]}, "windows differ"), ([WINDOWS, WINDOWS | {"windows": ["full", 1, 0]}], None, "differ"), ([plain, plain | {"seed": 2}], None, "differ"),
    ):
        with pytest.raises(ValueError, match=said):
            of(manifests, launcher)


def windowed(tmp_path, **change):
    """A run of the window suite of one session with two segments; a row is (condition, window, target, effective, fraction)."""
    folder = tmp_path / "run"
    folder.mkdir()
    rows = change.get("rows") or [("w0", 0, 0, 0, 0.0), ("w0", 0, 1, 0, 1.0), ("w1", 1, 0, 0, 0.0), ("w1", 1, 1, 1, 1.0), ("full", "", 0, 0, 0.0), ("full", "", 1, 1, 1.0)]
    head = "experiment,participant,choice_index,condition,window,target_index,effective_window,n_segments,target_fraction,is_anchor,human_choice,num_tokens,k_options,options_status"
    (folder / "predictions.0.csv").write_text("\n".join([head, *(f"a,1,{t},{c},{w},{t},{e},2,{f},true,x,1,2,scored" for c, w, t, e, f in rows)]) + "\n")
    top = [f"a,1,{t},{c},0,{r},{7 + r}" for c, _, t, *_ in rows for r in (0, 1)]
    (folder / "pred_topk.0.csv").write_text("\n".join(["experiment,participant,choice_index,condition,token_index,rank,token_id", *top]) + "\n")
    options = [f"a,1,{t},{c},{o},{change.get('logprob', -0.7)},1,{o == 'x'}" for c, _, t, *_ in rows for o in "xy"]
    (folder / "pred_options.0.csv").write_text("\n".join(["experiment,participant,choice_index,condition,option,logprob,n_tokens,is_human", *options]) + "\n")
    (folder / "launcher.json").write_text(json.dumps(WINDOWS | {"windows": [0, 1, "full"]}))
    (folder / "session_commits").mkdir()
    stated = change.get("conditions") or {"w0": 2, "w1": 2, "full": 2}
    receipt = {"schema": 1, "experiment": "a", "participant": "1", "status": "complete", "prediction_rows": sum(stated.values()), "conditions": stated}
    (folder / "session_commits" / f"{files_digest('a', '1')}.json").write_text(json.dumps(receipt))
    return str(folder)


def test_windowed_runs(spark, tmp_path):
    keys = ["experiment", "participant", "choice_index", "condition"]
    report = {r["table"]: r["rows"] for r in merge.merge_run(spark, windowed(tmp_path), 1, keys=keys)}
    assert report == {"predictions": 6, "pred_topk": 12, "pred_options": 12}


@pytest.mark.parametrize(
    "change, said",
    [
        ({"rows": [("w0", 0, 0, 0, 0.0), ("w1", 1, 0, 0, 0.0), ("w1", 1, 1, 1, 1.0), ("full", "", 0, 0, 0.0), ("full", "", 1, 1, 1.0)], "conditions": {"w0": 1, "w1": 2, "full": 2}}, "window protocol"),
        ({"rows": [("w0", 0, 0, 0, 0.0), ("w0", 0, 1, 1, 1.0), ("w1", 1, 0, 0, 0.0), ("w1", 1, 1, 1, 1.0), ("full", "", 0, 0, 0.0), ("full", "", 1, 1, 1.0)]}, "window protocol"),
        ({"conditions": {"w0": 2, "w2": 2, "full": 2}}, "other conditions"), ({"logprob": 0.5}, "options that can't be"),
    ],
)
def test_windowed_runs_that_are_not_merged(spark, tmp_path, change, said):
    with pytest.raises(merge.MergeError, match=said):
        merge.merge_run(spark, windowed(tmp_path, **change), 1, keys=["experiment", "participant", "choice_index", "condition"])


def test_failed_sessions_are_not_merged(spark, tmp_path):
    folder = run(tmp_path)
    (folder / "failed.0.csv").write_text("experiment,participant,error\n")
    (folder / "failed.1.csv").write_text("experiment,participant,error\nb,3,too long\n")
    with pytest.raises(merge.MergeError, match="failed sessions"):
        merge.merge_run(spark, str(folder), 2, KINDS)
    (folder / "failed.1.csv").write_text("experiment,participant,error\n")
    assert merge.merge_run(spark, str(folder), 2, KINDS)


@pytest.mark.parametrize("span", [1, 3, 100_000])
def test_parent_changes_in_ranges_equal_one_scan(spark, span):
    import random

    rng = random.Random(span)
    rows = [(s, i * rng.choice([1, 1, 7]) + 10 * i, rng.choice("ab")) for s in range(3) for i in range(40)]
    rows = list({(s, i): (s, i, k) for s, i, k in rows}.values())
    found = {(r.shard, r.row_idx): r.new for r in integrity.parent_changes(spark.createDataFrame(rows, "shard int, row_idx long, key string"), span).collect()}
    for s in range(3):
        before = None
        for _, i, k in sorted(r for r in rows if r[0] == s):
            assert found[s, i] == (k != before)
            before = k


def test_parameters(spark, tmp_path):
    assert parameters.parse_shard("1/4") == (1, 4) and parameters.parse_shard(None) is None
    assert parameters.parse_run("a=b=c") == ("a", "b=c") and parameters.parse_windows("0, 5,full") == [0, 5, "full"]
    for parse, texts in ((parameters.parse_shard, ["4/4", "-1/2", "x/2", "1"]), (parameters.parse_run, ["a", "=b", "a="]), (parameters.parse_windows, ["", "1,1", "-1", "x", "full,full"])):
        for text in texts:
            with pytest.raises(ValueError, match="shard|label|window"):
                parse(text)
    name = parameters.write_manifest(spark, str(tmp_path / "m"), {"top_k": 2}, 1)
    said = json.loads((tmp_path / "m" / "manifest.1.json").read_text())
    assert said["top_k"] == 2 and said["shard"] == 1 and "pyspark" in said["versions"] and name.endswith("manifest.1.json")
    assert merge.read_manifests(spark, str(tmp_path / "m"))[0]["top_k"] == 2
    with pytest.raises(FileExistsError):
        parameters.write_manifest(spark, str(tmp_path / "m"), {}, 1)


def test_more_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" x ,y\n1,2\n")
    (tmp_path / "b.json").write_text('{"x": "3", "z": 4}\n')
    spark.range(2).selectExpr("cast(id as string) as x").coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    rows = readers.read_tables(spark, [str(tmp_path / n) for n in ("a.csv", "b.json", "c.parquet")])
    assert set(rows.columns) == {"x", "y", "z"} and sorted(r.x for r in rows.collect()) == ["0", "1", "1", "3"]
    (tmp_path / "d.csv").write_text("x, x\n1,2\n")
    with pytest.raises(ValueError, match="repeat"):
        readers.read_tables(spark, [str(tmp_path / "d.csv")])
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_tables(spark, [str(tmp_path / "d.txt")])
    with pytest.raises(ValueError, match="no files"):
        readers.read_tables(spark, [])
    for k in (0, 1):
        spark.createDataFrame([(f"{k}{i}",) for i in range(3)], "v string").coalesce(1).write.parquet(str(tmp_path / f"tables/task{k}"))
    table = readers.read_canonical(spark, str(tmp_path / "tables"))
    assert sorted((r.v, r.row_idx) for r in table.collect()) == [(f"{k}{i}", i) for k in (0, 1) for i in range(3)]
    for k in (0, 2):
        (tmp_path / f"p.{k}.csv").write_text("v\n1\n")
    with pytest.raises(ValueError, match="shards"):
        readers.shard_files(spark.read.option("header", True).csv([str(tmp_path / f"p.{k}.csv") for k in (0, 2)]), 2)
    assert readers.read_completed(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_completed(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "done.csv").write_text("experiment,participant,nll\na,1,0\na,1,1\n")
    assert [tuple(r) for r in readers.read_completed(spark, str(tmp_path / "done.csv")).collect()] == [("a", "1")]


def test_host_samples(spark, tmp_path):
    (tmp_path / "gpu.csv").write_text("0, card , 40\n\nbroken, row\n1,card,50\n")
    rows = readers.read_gpu_samples(spark, str(tmp_path / "gpu.csv"), ["index", "name", "load"]).collect()
    assert [tuple(r) for r in rows] == [("0", "card", "40"), ("1", "card", "50")]
    (tmp_path / "mem").write_text("MemTotal:  4096 kB\nMemAvailable: 1024 kB\nodd\nHugePages: x\n")
    assert tuple(readers.read_memory_sample(spark, str(tmp_path / "mem")).first()) == (3.0, 4.0)
    assert tuple(readers.read_memory_sample(spark, str(tmp_path / "no")).first()) == (None, None)


def test_more_writers(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "1", 0, "x")], "experiment string, participant string, choice_index int, error string")
    writers.write_tables({"predictions": rows.where("false"), "pred_topk": rows}, out)
    assert not files.exists(spark, out)
    writers.guard_output(spark, out, False)
    writers.write_tables({"predictions": rows, "pred_topk": rows}, out)
    writers.guard_output(spark, out, True)
    with pytest.raises(FileExistsError):
        writers.guard_output(spark, out, False)
    writers.log_sessions(rows.where("false"), out, "failed")
    assert files.listed(spark, out) == ["pred_topk", "predictions"]
    writers.log_sessions(rows, out, "failed", 1)
    assert merge.failed_sessions(spark, out).count() == 1
    writers.write_report(rows, f"{out}/report")
    assert spark.read.option("header", True).csv(f"{out}/report").first().error == "x"
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_report(rows, f"{out}/report")


def test_parents_are_not_broadcast(spark):
    """Parents are as many as choices, whatever their file's size."""
    from choicegrid.operators import integrity
    from choicegrid.schemas import CHOICE
    from choicegrid.sources.files import written

    kind = "experiment string, participant string, choice_index int"
    children = spark.createDataFrame([("e", "1", 0, k, 0, k) for k in (0, 1)], f"{kind}, token_index int, shard int, row_idx long")
    parents = written(spark.createDataFrame([("e", "1", 0, 2)], f"{kind}, expected int"))
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (integrity.occurrence_outcomes(children, parents, CHOICE, ["token_index"]), integrity.incomplete(children, parents, CHOICE, ["token_index"]))]
    assert all("strategy=merge" in p for p in plans)
