"""Reading tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Intermediate tables that this session has written and not yet removed.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The table goes when the driver's JVM ends, or with release().
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(name)
    path, system = _path(spark, name)
    system.deleteOnExit(path)
    _tables.append(name)
    return spark.read.schema(df.schema).parquet(name)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far; results that were not written yet can't be read after that."""
    n = len(_tables)
    while _tables:
        path, system = _path(spark, _tables.pop())
        system.delete(path, True)
    return n


#: Rows of a key from which it is a hot one, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """rows joined with keyed, which has one row per key and in count how many rows have it (column count is dropped).

    Of n rows in all fewer than n / m have a key that more than m rows share, so the hot keys' rows of keyed, at most
    HOT_KEYS, are broadcast; only rows of other keys are shuffled, and no task gets a hot key.
    """
    most = max(HOT_ROWS, -(-n // HOT_KEYS))
    hot = F.broadcast(keyed.where(F.col(count) > most).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(count) <= most).drop(count), key)
    return rows.join(hot, key).unionByName(rest)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's decimal text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Distinct numbers in ascending order, by a sort."""
    ordered = np.sort(numbers)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filter_rows(docs: DataFrame, inputs: list[Column], decide: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns whatever these are called, for which decide (a batch of inputs) is true."""
    packed = docs.select(F.struct(*inputs).alias("inputs"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))

    def run(batches):
        for batch in batches:
            kept = decide(pa.RecordBatch.from_struct_array(batch.column(0)))
            yield pa.RecordBatch.from_struct_array(batch.column(1)).filter(pa.array(kept, pa.bool_()))

    return packed.mapInArrow(run, docs.schema)
