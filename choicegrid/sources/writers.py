"""Writers: flat tables of a scored run, receipts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHOICE, SESSION
from .files import exists
from .readers import CSV, session_digest


def shape_scores(scored: DataFrame, constants: dict[str, str], keys: list[str] = CHOICE) -> dict[str, DataFrame]:
    """predictions, pred_topk and pred_options from nested scores (topk: array of structs, options: array of structs); keys tell scores apart."""
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    flat = [c for c in scored.columns if c not in ("topk", "options", *keys)]
    keys = [*fixed, *keys]
    out = {"predictions": scored.select(*keys, *flat)}
    for name, column in (("pred_topk", "topk"), ("pred_options", "options")):
        if column in scored.columns:
            out[name] = scored.select(*keys, F.inline(column))
    return out


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Children first, the predictions last: a table of predictions vouches for its children. Without predictions nothing is written."""
    if "predictions" in tables and tables["predictions"].isEmpty():
        return
    for name in sorted(tables, key=lambda n: n == "predictions"):
        tables[name].write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")


def receipts(predictions: DataFrame) -> DataFrame:
    """One receipt per session: digest, prediction_rows and rows per condition."""
    per = predictions.groupBy(*SESSION, "condition").agg(F.count("*").alias("n"))
    rows = per.groupBy(*SESSION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "n")))).alias("conditions"), F.sum("n").alias("prediction_rows"))
    return rows.select(F.lit(1).alias("schema"), *SESSION, F.lit("complete").alias("status"), "prediction_rows", "conditions", session_digest().alias("digest"))


def guard_output(spark: SparkSession, path: str, resume: bool) -> None:
    """An output that is there already is an error unless the run resumes."""
    if exists(spark, path) and not resume:
        raise FileExistsError(f"{path} is there; resume or name another one")


def log_sessions(rows: DataFrame, path: str, kind: str, shard: int = 0) -> None:
    """Sessions that were left out (`skipped`) or didn't work (`failed`), as the CSV log `<kind>.<shard>.csv` beside the output; none, no log."""
    if kind not in ("skipped", "failed"):
        raise ValueError(f"unknown log {kind!r}")
    if not rows.isEmpty():
        rows.write.mode("append").options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(f"{path}/{kind}.{shard}.csv")


def write_report(table: DataFrame, path: str) -> None:
    """An analysis table as CSV with a header; an existing one is an error."""
    table.write.mode("errorifexists").options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)
