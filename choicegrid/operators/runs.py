"""Scoring runs that can be stopped anywhere and resumed: a session's rows count once its receipt is there.

Sessions are scored in waves. A wave's nested scores are written once and split into tables, each into a folder of the wave's
attempt; the attempt's receipts are moved into place last, in one step. What an attempt without receipts has left is removed
at the next start, and its sessions are scored anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SESSION
from ..sources.files import listed, move, remove
from ..sources.readers import pending_sessions
from ..sources.writers import guard_output, receipts, shape_scores

TABLES = ("pred_topk", "pred_options", "predictions")
COMMITS = "session_commits"


def attempts(spark: SparkSession, path: str) -> list[str]:
    """Attempts whose receipts are published, one per wave."""
    return [n for n in listed(spark, f"{path}/{COMMITS}") if n.startswith("attempt-")]


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """Receipts of all sessions that are done."""
    names = attempts(spark, path)
    return spark.read.parquet(*(f"{path}/{COMMITS}/{n}" for n in names)) if names else None


def finished(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The rows of a table that receipts vouch for; None before any wave is done or where no wave has the table."""
    names = set(attempts(spark, path)) & set(listed(spark, f"{path}/{table}"))
    return spark.read.parquet(*(f"{path}/{table}/{n}" for n in sorted(names))) if names else None


def remove_unfinished(spark: SparkSession, path: str) -> int:
    """Remove what attempts without receipts have left; returns how many folders that were."""
    done, found = set(attempts(spark, path)), []
    for table in TABLES:
        found += [f"{path}/{table}/{n}" for n in listed(spark, f"{path}/{table}") if n not in done]
    found += [f"{path}/{n}" for n in listed(spark, path) if n.startswith("_")]
    for name in found:
        remove(spark, name)
    return len(found)


def score_run(
    sessions: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], keys: list[str], constants: dict[str, str] | None = None, waves: int = 8, resume: bool = False, most_waves: int | None = None
) -> int:
    """Score the sessions that have no receipt in path yet; returns how many waves were published.

    score gives nested scores of a part of the sessions, with condition, and keys tell a session's scores apart. A wave is a
    hash of the session modulo waves, so a run that breaks loses one wave's work at most; most_waves ends it early. A session
    without a marked choice gets a receipt of no rows (status `empty`). An output that is there is an error unless the run
    resumes. experiment and participant must be unique among sessions.
    """
    spark = sessions.sparkSession
    guard_output(spark, path, resume)
    remove_unfinished(spark, path)
    done = commits(spark, path)
    left = sessions if done is None else pending_sessions(sessions, done)
    wave = F.pmod(F.xxhash64(*SESSION, F.lit(17)), F.lit(waves))
    numbers = [r["wave"] for r in left.select(wave.alias("wave")).distinct().orderBy("wave").collect()]  # at most waves
    for k in numbers[:most_waves]:
        publish_wave(left.where(wave == k), path, score, keys, constants or {})
    return len(numbers[:most_waves])


def publish_wave(rows: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], keys: list[str], constants: dict[str, str]) -> None:
    """One wave: nested scores, their tables, children first, and the receipts."""
    spark, attempt = rows.sparkSession, f"attempt-{uuid.uuid4().hex}"
    nested = f"{path}/_{attempt}"
    score(rows).write.option("compression", "zstd").parquet(nested)
    tables = shape_scores(spark.read.parquet(nested), constants, keys)
    for name in TABLES:
        if name in tables:
            tables[name].write.option("compression", "zstd").parquet(f"{path}/{name}/{attempt}")
    said = receipts(spark.read.parquet(f"{path}/predictions/{attempt}")).drop("digest")
    none = F.create_map().cast("map<string,bigint>")
    every = rows.select(*SESSION).join(said, SESSION, "left").select(
        F.lit(1).alias("schema"), *SESSION, F.coalesce("status", F.lit("empty")).alias("status"), F.coalesce("prediction_rows", F.lit(0).cast("long")).alias("prediction_rows"), F.coalesce("conditions", none).alias("conditions")
    )
    every.coalesce(1).write.parquet(f"{path}/_commits-{attempt}")
    move(spark, f"{path}/_commits-{attempt}", f"{path}/{COMMITS}/{attempt}")
    remove(spark, nested)
