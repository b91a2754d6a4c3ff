"""Column sets and key lists that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

SESSION = ["experiment", "participant"]
CHOICE = [*SESSION, "choice_index"]
PARENT = ["model", "dataset", "condition", *CHOICE]

SESSION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("experiment", "participant", "text")])
SCORE_SCHEMA = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("participant", T.StringType()),
        T.StructField("choice_index", T.IntegerType()),
        T.StructField("nll", T.DoubleType()),
        T.StructField("num_tokens", T.IntegerType()),
    ]
)
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("participant", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("prediction_rows", T.LongType()),
        T.StructField("conditions", T.MapType(T.StringType(), T.LongType())),
    ]
)
