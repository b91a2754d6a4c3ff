"""Token arrays for supervised training: spans to tokens, masks, truncation, padding, marked records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the label of a token that isn't learned.
IGNORE = -100


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _overlapping(tokens: pa.Array, spans: pa.Array) -> pa.Array:
    """Two binary searches per span, over all rows of a batch at once; tokens are in the order of the text."""
    t_at, s_at = (np.asarray(x.offsets, np.int64) - int(x.offsets[0].as_py()) for x in (tokens, spans))
    t, s = tokens.flatten(), spans.flatten()
    t_row, s_row = np.repeat(np.arange(len(tokens)), np.diff(t_at)), np.repeat(np.arange(len(spans)), np.diff(s_at))
    begin, end = (np.asarray(pc.struct_field(t, [k]), np.int64) for k in (0, 1))
    first, last = (np.asarray(pc.struct_field(s, [k]), np.int64) for k in (0, 1))
    some = np.flatnonzero(end > begin)  # empty tokens overlap nothing
    far = int(max(end.max(initial=0), last.max(initial=0))) + 1
    # row after row on one line, so that one search serves all
    begin, end = t_row[some] * far + begin[some], t_row[some] * far + end[some]
    low, high = np.searchsorted(end, s_row * far + first, "right"), np.searchsorted(begin, s_row * far + last, "left")
    n = np.maximum(high - low, 0)
    places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    places = some[places] - t_at[t_row[some[places]]]
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(places, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(s_at, pa.int32()), inner)


def tokens_of_spans(tokens: Column, spans: Column) -> Column:
    """For each span (start, end) the places of the tokens (start, end) that overlap it; empty tokens overlap nothing.

    Tokens are in the order of the text and don't overlap each other. A null array counts as an empty one.
    """
    pair = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return _overlapping(pair(tokens), pair(spans))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _learned(ids: pa.Array, places: pa.Array) -> pa.Array:
    at = np.asarray(ids.offsets, np.int64)
    at = at - at[0]
    inner = places.flatten()
    counts = np.add.reduceat(np.append(np.asarray(pc.list_value_length(inner), np.int64), 0), np.asarray(places.offsets, np.int64)[:-1] - int(places.offsets[0].as_py())) if len(inner) else np.zeros(len(places), np.int64)
    counts = np.where(np.asarray(pc.list_value_length(places), np.int64) > 0, counts, 0)
    out = np.full(int(at[-1]), IGNORE, np.int32)
    chosen = np.repeat(at[:-1], counts) + np.asarray(inner.flatten(), np.int64)
    out[chosen] = np.asarray(ids.flatten(), np.int32)[chosen]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))


def supervised_labels(ids: Column, token_places: Column) -> Column:
    """ids where a span's token is, else IGNORE. Null arrays count as empty."""
    return _learned(F.coalesce(ids, F.array()).cast("array<int>"), F.coalesce(token_places, F.array()).cast("array<array<int>>"))


def has_supervision(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE)


def truncated(values: Column, most: int, side: str = "head") -> Column:
    """The first (head) or last (tail) `most` values."""
    if most < 1 or side not in ("head", "tail"):
        raise ValueError("most must be positive and side head or tail")
    return F.slice(values, 1, most) if side == "head" else F.when(F.size(values) > most, F.slice(values, -most, most)).otherwise(values)


def padded(values: Column, width: Column, fill: int) -> Column:
    """values with fill behind them up to width."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))))


def ascii_json(json: Column) -> Column:
    """JSON text whose characters beyond ASCII are written as \\u and four hexadecimal digits, two such where needed."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(code(F.shiftright(n - 0x10000, 10) + 0xD800), code((n - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, code(n)).otherwise(pair)

    # (?s). takes whole code points, which a split at nothing doesn't promise
    each = F.array_join(F.transform(F.regexp_extract_all(json, F.lit("(?s)(.)"), F.lit(1)), escaped), "")
    return F.when(json.rlike(r"[^\x00-\x7f]"), each).otherwise(json)


def marked_record(context: list[str], targets: list[str]) -> Column:
    """A row as text: its context as JSON, then its targets as JSON between marks. Nulls and numbers that are NaN are null."""
    number = lambda c: F.typeof(c).isin("double", "float")
    clean = lambda c: F.when(~number(F.col(c)) | ~F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False)), F.col(c)).alias(c)
    json = lambda names: ascii_json(F.to_json(F.struct(*map(clean, names)), {"ignoreNullFields": "false"}))
    return F.concat(F.lit("trial="), json(context), F.lit("\ntarget=<<"), json(targets), F.lit(">>\n"))
