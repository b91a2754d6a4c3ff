"""Readers: sessions, score tables, prediction tables, canonical tables, shards, receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, number
from ..schemas import COMMIT_SCHEMA, SCORE_SCHEMA, SESSION, SESSION_SCHEMA
from .files import exists, written

#: Labels may hold line ends, quotes and leading blanks, and `NA` is a label.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_sessions(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """experiment, participant, text of JSON lines in UTF-8, and row_idx, the lines' order from 0 on unless not numbered; participants are text whatever they look like.

    Several files count one after the other by their paths. Blank lines are no rows.
    """
    lines = spark.read.schema(SESSION_SCHEMA).option("mode", "FAILFAST").option("primitivesAsString", True).option("encoding", "UTF-8").json(path)
    return number_rows(lines, "experiment") if numbered else lines


def number_rows(scan: DataFrame, column: str) -> DataFrame:
    """scan, a reading of files as they are, with row_idx: each row's dense number in the order of paths and lines.

    Two passes: the first counts the rows of every split of a file (reading `column` alone) and adds the counts up, splits
    within their file and files among each other, which is one row per file in one task; the second adds a split's start to
    a row's place in it. No row is moved. Both passes cut the files alike; a row that doesn't fit the counts fails the query.
    """
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    rows = scan.select("*", *split, F.monotonically_increasing_id().alias("__id"))
    # both kinds are counted, so that the column is read and blank lines are passed over as in the second pass
    n = F.count(column) + F.count_if(F.col(column).isNull())
    splits = written(rows.groupBy("__file", "__block").agg(n.alias("__n"), F.min("__id").alias("__first")))
    before = lambda by, order: F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__n")).select("__file", before([], "__file").alias("__base"))
    starts = splits.join(files, "__file").select("__file", "__block", "__n", "__first", (F.col("__base") + before(["__file"], "__block")).alias("__start"))
    place = F.col("__id") - F.col("__first")
    fits = F.when((place < 0) | (place >= F.col("__n")), F.raise_error(F.lit("the files were cut otherwise in the second pass")).cast("long")).otherwise(place)
    return rows.join(starts, ["__file", "__block"]).select(*scan.columns, (F.col("__start") + fits).alias("row_idx"))


def repair_names(frame: DataFrame, repairs: dict[str, str]) -> DataFrame:
    """experiment with each wrongly decoded part replaced."""
    name = F.col("experiment")
    for wrong, right in repairs.items():
        name = F.replace(name, F.lit(wrong), F.lit(right))
    return frame.withColumn("experiment", name)


def read_scores(spark: SparkSession, path: str, repairs: dict[str, str] | None = None) -> DataFrame:
    """Score rows of CSV files (plain or .gz, a file or a folder) by the names in their header."""
    return repair_names(read_csv(spark, path, SCORE_SCHEMA), repairs or {})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns of CSV files, found by header; a column that a file lacks is an error, an unreadable value too."""
    text = spark.read.options(**CSV).csv(path)
    missing = [f.name for f in schema if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return text.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def read_predictions(spark: SparkSession, path: str, columns: Sequence[str], condition: str | None = None, guard: str | None = "nll") -> DataFrame:
    """Columns of prediction CSV files as text, numbers cast, empty text kept; a value of `guard` that isn't finite fails the query."""
    numbers = {"choice_index": "int", "num_tokens": "int", "k_options": "int", "nll": "double", "legal_mass": "double", "entropy": "double", "token_id": "int", "rank": "int"}
    rows = spark.read.options(**CSV).csv(path)
    if condition is not None:
        rows = rows.where(F.col("condition") == condition)
    kinds = {c: F.col(c).cast(numbers[c]) if c in numbers else F.coalesce(F.col(c), F.lit("")) for c in columns}
    if guard in kinds:
        kinds[guard] = finite(kinds[guard], guard)
    return rows.select(*(x.alias(c) for c, x in kinds.items()))


def read_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of CSV, JSON (lines) or Parquet by their suffix, one below the other, columns matched by name."""
    frames = []
    for path in paths:
        kind = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
        if kind == "csv":
            frame = spark.read.options(**CSV).csv(path)
        elif kind in ("json", "jsonl"):
            frame = spark.read.json(path)
        elif kind == "parquet":
            frame = spark.read.parquet(path)
        else:
            raise ValueError(f"{path}: unknown format")
        frames.append(normalized_names(frame))
    if not frames:
        raise ValueError("no files")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files below path with file and row_idx, which give the order of trials."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_idx"))


def shard_files(frame: DataFrame, shards: int) -> DataFrame:
    """frame with shard, from names that end in `.<k>.csv` or the like; the shards must be exactly 0..shards-1."""
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\d+)\.[A-Za-z.]+$", 1).cast("int")
    numbered = frame.select("*", shard.alias("shard"))
    found = {r["shard"] for r in numbered.select("shard").distinct().limit(shards + 1).collect()}
    if found != set(range(shards)):
        raise ValueError(f"shards {sorted(found)} are there, not 0..{shards - 1}")
    return numbered


def completed_sessions(predictions: DataFrame) -> DataFrame:
    return predictions.select(*SESSION).distinct()


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Sessions that prediction files (CSV) hold already; a path that isn't there, or an empty file, holds none."""
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in SESSION))
    if not exists(spark, path):
        return none
    rows = spark.read.options(**CSV).csv(path)
    return completed_sessions(rows) if set(SESSION) <= set(rows.columns) else none


def read_gpu_samples(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Samples of a device monitor, comma-separated without a header, as trimmed text; rows of another length are passed over."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("x")).where(F.size("x") == len(fields))
    return rows.select(*(F.get("x", F.lit(i)).alias(f) for i, f in enumerate(fields)))


def read_memory_sample(spark: SparkSession, path: str) -> DataFrame:
    """used_mib, total_mib of a host's memory listing (`name: amount kB` per line); null where a line lacks or the file does."""
    if not exists(spark, path):
        return spark.createDataFrame([(None, None)], "used_mib double, total_mib double")
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.rtrim(F.get(parts, F.lit(0)), F.lit(":")).alias("name"), (number(F.get(parts, F.lit(1))) / 1024).alias("mib"))
    table = rows.agg(F.max(F.when(F.col("name") == "MemTotal", F.col("mib"))).alias("total_mib"), F.max(F.when(F.col("name") == "MemAvailable", F.col("mib"))).alias("free"))
    return table.select((F.col("total_mib") - F.col("free")).alias("used_mib"), "total_mib")


def normalized_names(frame: DataFrame) -> DataFrame:
    """frame with stripped column names, `None` for one without any; names that repeat then are an error."""
    names = [c.strip() or "None" for c in frame.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names repeat")
    return frame.toDF(*names)


def pending_sessions(sessions: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions without a receipt or output yet."""
    return sessions.join(done.select(*SESSION).distinct(), SESSION, "left_anti")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Session receipts, one JSON object per file; the file's name must be the digest of the session."""
    rows = spark.read.schema(COMMIT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), session_digest().alias("digest"))


def session_digest():
    """SHA-256 of the session's keys as a compact JSON list."""
    return F.sha2(F.to_json(F.array("experiment", "participant")), 256)


