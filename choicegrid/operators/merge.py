"""Merge of a sharded run: everything is validated and staged first, then published, the predictions last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHOICE
from ..sources import readers
from ..sources.files import exists, first_line, listed, move, read_text, remove, written
from . import contract, integrity, protocol


class MergeError(ValueError):
    """What makes a run unfit to be merged."""


@dataclass(frozen=True)
class Child:
    """A table below the predictions: what tells a parent's rows apart, and (in SQL) how many rows a parent expects."""

    suffix: list[str]
    expected: str


def refuse(rows: DataFrame, what: str) -> None:
    """An error that names one of the rows, if there are any."""
    found = rows.head()
    if found is not None:
        raise MergeError(f"{what}: {found.asDict()}")


def merged_tables(predictions: DataFrame, children: dict[str, DataFrame], kinds: dict[str, Child], keys: list[str] = CHOICE) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): one row per prediction, and the first whole occurrence of its rows in each child table.

    All have shard and row_idx. A key that crosses shards, a replay that differs, a child in another shard than its parent
    and a parent without all of its rows are errors; children without a parent, replays and parts of an occurrence are
    dropped. report has table, rows, replays, incomplete, orphans.
    """
    payload = [c for c in predictions.columns if c not in ("shard", "row_idx", *keys)]
    refuse(integrity.merge_violations(predictions, keys, payload), "predictions that differ between replays or shards")
    parents = written(integrity.merge_predictions(predictions, keys, payload))
    tables = {"predictions": parents.drop("copies")}
    report = parents.agg(F.lit("predictions").alias("table"), F.count("*").alias("rows"), (F.sum("copies") - F.count("*")).alias("replays"), F.lit(0).cast("long").alias("incomplete"), F.lit(0).cast("long").alias("orphans"))
    for name, rows in children.items():
        kind = kinds[name]
        wanted = parents.select(*keys, F.col("shard").alias("parent_shard"), F.expr(kind.expected).cast("long").alias("expected"))
        # joins of rows with their parents are merges: a table's bytes on disk, compressed, say little of what a broadcast would hold
        refuse(rows.join(wanted.hint("merge"), keys).where("shard <> parent_shard").select(*keys, "shard", "parent_shard"), f"{name}: a row in another shard than its parent")
        outcomes = written(integrity.occurrence_outcomes(rows, wanted, keys, kind.suffix))
        kept = rows.join(outcomes.where("outcome = 'kept'").select("shard", "row_idx").hint("merge"), ["shard", "row_idx"], "left_semi")
        refuse(integrity.incomplete(kept, wanted.where("expected > 0"), keys, kind.suffix), f"{name}: a prediction without all of its rows")
        n = {k: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(k) for k, o in (("rows", "kept"), ("replays", "replay"), ("incomplete", "incomplete"), ("orphans", "orphan"))}
        report = report.unionByName(outcomes.agg(F.lit(name).alias("table"), *n.values()))
        tables[name] = kept.drop("row_idx")
    return tables, report


def run_shards(spark: SparkSession, run_dir: str, table: str, shards: int) -> DataFrame:
    """Rows of the files `<table>.<k>.csv` of a run as text, with shard and row_idx, their order in the shard.

    The shards must be exactly 0..shards-1, and their headers alike.
    """
    names = [n for n in listed(spark, run_dir) if n.startswith(f"{table}.") and n.endswith(".csv")]
    found = sorted(n[len(table) + 1 : -4] for n in names)
    if found != sorted(map(str, range(shards))):
        raise MergeError(f"{table}: shards {found} are there, not 0..{shards - 1}")
    headers = {first_line(spark, f"{run_dir}/{table}.{k}.csv") for k in range(shards)}
    if len(headers) > 1:
        raise MergeError(f"{table}: headers differ")
    # a file of several lines per record isn't split, so numbers grow along it
    rows = spark.read.options(**readers.CSV).csv([f"{run_dir}/{table}.{k}.csv" for k in range(shards)])
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d+)\.csv$", 1).cast("long")
    return rows.select("*", shard.alias("shard"), F.monotonically_increasing_id().alias("row_idx"))


def failed_sessions(spark: SparkSession, run_dir: str) -> DataFrame | None:
    """Rows of the logs `failed.<k>.csv`; None where there is no log."""
    names = [n for n in listed(spark, run_dir) if n.startswith("failed.") and n.endswith(".csv")]
    return spark.read.options(**readers.CSV).csv([f"{run_dir}/{n}" for n in names]) if names else None


def read_manifests(spark: SparkSession, run_dir: str) -> list[dict]:
    """The files `manifest.<k>.json`, one small object per shard."""
    names = sorted(n for n in listed(spark, run_dir) if n.startswith("manifest.") and n.endswith(".json"))
    return [json.loads(r["value"]) for r in spark.read.text([f"{run_dir}/{n}" for n in names], wholetext=True).collect()] if names else []


def read_launcher(spark: SparkSession, run_dir: str) -> dict | None:
    """The launcher's file of a run, if there is one."""
    name = f"{run_dir}/launcher.json"
    return json.loads(read_text(spark, name)) if exists(spark, name) else None


def stated_children(stated: contract.Contract) -> dict[str, Child]:
    """The child tables that a contract asks for."""
    top = {"pred_topk": Child(["token_index", "rank"], f"num_tokens * {stated.top_k}")} if stated.top_k else {}
    return top | {"pred_options": Child(["option"], "IF(options_status = 'scored', k_options, 0)")}


def check_rules(tables: dict[str, DataFrame], stated: contract.Contract, commits: DataFrame | None, keys: list[str]) -> None:
    """An error unless predictions keep the window protocol (where the run is of that suite), receipts name their conditions, and options can be."""
    predictions = contract.typed(tables["predictions"])
    if stated.windows is not None:
        refuse(protocol.window_violations(predictions, list(stated.windows.windows)), "rows that break the window protocol")
    if commits is not None:
        refuse(integrity.commit_violations(commits, predictions), "receipts that don't fit")
        if "condition" in predictions.columns:
            refuse(protocol.session_conditions(predictions, commits), "receipts of other conditions")
    if "pred_options" in tables:
        refuse(protocol.option_violations(contract.typed(tables["pred_options"]), predictions, keys), "options that can't be")


def merge_run(spark: SparkSession, run_dir: str, shards: int, kinds: dict[str, Child] | None = None, keys: list[str] = CHOICE) -> list[dict]:
    """Merge a run's shards into `<run_dir>/merged/<table>` (Parquet) and return the report's rows.

    Manifests and the launcher's file must make a contract (contract_of), shards be complete, failure logs empty, tables
    fulfil merged_tables and check_rules. Child tables are the contract's unless kinds names them. Shards are read once, into
    Parquet. Tables are staged beside the goal and moved there when all of them are written, the predictions last, so readers
    never see a parent without its children. A merged run is not merged again.
    """
    stated = contract.contract_of(read_manifests(spark, run_dir), read_launcher(spark, run_dir), shards)
    kinds = stated_children(stated) if kinds is None else kinds
    goal = f"{run_dir}/merged"
    if exists(spark, f"{goal}/predictions"):
        raise MergeError(f"{goal} is there already")
    failures = failed_sessions(spark, run_dir)
    if failures is not None:
        refuse(failures, "failed sessions")
    staging = f"{run_dir}/_staging-{uuid.uuid4().hex}"
    try:
        raw = {}
        for table in ("predictions", *kinds):
            run_shards(spark, run_dir, table, shards).write.parquet(f"{staging}/raw_{table}")
            raw[table] = spark.read.parquet(f"{staging}/raw_{table}")
        tables, report = merged_tables(raw["predictions"], {t: raw[t] for t in kinds}, kinds, keys)
        commits = readers.read_commits(spark, f"{run_dir}/session_commits") if exists(spark, f"{run_dir}/session_commits") else None
        check_rules(tables, stated, commits, keys)
        for name, table in tables.items():
            table.write.option("compression", "zstd").parquet(f"{staging}/{name}")
        rows = [r.asDict() for r in report.collect()]  # one per table
        for name in (*kinds, "predictions"):
            move(spark, f"{staging}/{name}", f"{goal}/{name}")
        return rows
    finally:
        remove(spark, staging)
