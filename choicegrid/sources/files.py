"""Files of a run through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _path(spark, name)
    return bool(system.exists(path))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    path, system = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def move(spark: SparkSession, source: str, goal: str) -> None:
    """Rename source to goal, whose folder is made; a goal that is there, or a rename that fails, is an error."""
    (old, system), (new, _) = _path(spark, source), _path(spark, goal)
    if system.exists(new):
        raise FileExistsError(goal)
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"{source} can't be moved to {goal}")


def remove(spark: SparkSession, name: str) -> None:
    path, system = _path(spark, name)
    system.delete(path, True)


def read_text(spark: SparkSession, name: str) -> str:
    """A small file in UTF-8."""
    path, system = _path(spark, name)
    stream = system.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, name: str) -> str | None:
    """The first line of a file, without reading on; None of an empty one."""
    path, system = _path(spark, name)
    stream = system.open(path)
    try:
        java = spark._jvm.java.io
        return java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file, written beside its place first and moved there; an existing one is an error."""
    path, system = _path(spark, f"{name}._part")
    out = system.create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    move(spark, f"{name}._part", name)


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables in spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Where that is unset, a local session gets a folder of its warehouse, and a cluster an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/work-{uuid.uuid4().hex}"
    path, system = _path(spark, name)
    system.deleteOnExit(path)
    return name


def written(frame: DataFrame) -> DataFrame:
    """frame as a table in a work folder: what is read more than once is computed once, and a lost executor costs nothing."""
    name = work_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(name)
    return frame.sparkSession.read.schema(frame.schema).parquet(name)
