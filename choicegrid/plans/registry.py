"""Queries by name, each with its SQL twin; doubles are rounded alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; its doubles are rounded to six places."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in frame.dtypes))
