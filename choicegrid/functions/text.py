"""Marked transcripts: spans, segments, context windows and target grids, in string and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound

OPEN, CLOSE = "<<", ">>"


def choices(text: Column) -> Column:
    """Labels of all marked spans of a transcript, in order; an unclosed marker is none."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<<(.*?)>>"), F.lit(1))


def span_places(text: Column) -> Column:
    """start and end of every marked label, as zero-based code points."""
    # the text is split and its labels are found once; lengths are all that the places need
    sizes = F.struct(
        F.transform(F.split(text, r"(?s)<<.*?>>", -1), lambda x: F.length(x)).alias("between"), F.transform(choices(text), lambda x: F.length(x)).alias("labels")
    )

    def places(s: Column) -> Column:
        def place(state: Column, pair: Column) -> Column:
            start = state["at"] + pair["between"] + 2
            end = start + pair["labels"]
            return F.struct((end + 2).alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        # what follows the last label has no partner
        pairs = F.arrays_zip(F.slice(s["between"], F.lit(1), F.size(s["labels"])).alias("between"), s["labels"].alias("labels"))
        return F.aggregate(pairs, empty, place)["out"]

    return bound(sizes, places)


def header(text: Column) -> Column:
    """What precedes the first marker, up to the end of the last run of blank lines there; else empty."""
    before = F.substring_index(text, OPEN, 1)
    return F.when(F.instr(text, OPEN) > 0, F.regexp_extract(before, r"(?s)^(.*\n(?:[ \t]*\n)+)", 1))


def segments(text: Column) -> Column:
    """The text after the header in pieces that end with a line that holds an opening marker; the tail is left out.

    A text without an opening marker has null segments.
    """
    body = F.substr(text, F.length(header(text)) + 1)
    return F.when(F.instr(text, OPEN) > 0, F.regexp_extract_all(body, F.lit(r"(?s)(.*?<<[^\n]*(?:\n|$))"), F.lit(1)))


def tail(text: Column) -> Column:
    """What follows the last segment."""
    return F.substr(text, F.length(header(text)) + F.length(F.array_join(segments(text), "")) + 1)


def window_prompt(head: Column, parts: Column, target: Column, window: Column) -> Column:
    """Header, up to `window` segments before the target, and the target (zero-based)."""
    first = F.greatest(target - window, F.lit(0))
    return F.concat(head, F.array_join(F.slice(parts, first + 1, target - first + 1), ""))


def even_targets(n_segments: Column, points: int) -> Column:
    """At most `points` places spread evenly over 0..n-1, each once; the last one alone for one point."""
    if points == 1:
        return F.array(n_segments - 1)
    step = (n_segments - 1) / F.lit(points - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * step).cast("int"))
    return F.when(n_segments <= points, F.sequence(F.lit(0), n_segments - 1)).otherwise(F.array_sort(F.array_distinct(spread)))


def anchor_targets(n_segments: Column) -> Column:
    """Five places: first, second, a tenth, half and last; kept apart where the text is short."""
    last = n_segments - 1
    wished = F.array(F.lit(0.0), F.lit(1.0), last * F.lit(0.1), last * F.lit(0.5), last.cast("double"))

    def place(done: Column, i: Column) -> Column:
        low = F.coalesce(F.element_at(done, -1) + 1, F.lit(0))
        high = n_segments - (5 - i)
        return F.concat(done, F.array(F.least(F.greatest(F.bround(F.get(wished, i)).cast("int"), low), high)))

    # try_element_at of an empty list is null, hence the first place starts at 0
    start = F.array().cast("array<int>")
    found = F.aggregate(F.sequence(F.lit(0), F.lit(4)), start, lambda d, i: F.when(F.size(d) == 0, F.array(F.lit(0))).otherwise(place(d, i)))
    return F.when(n_segments <= 5, F.sequence(F.lit(0), n_segments - 1)).otherwise(found)
