"""Fill-in-the-middle training texts: units are cut by a zero-width regex, pieces change places between control strings.

A unit grammar is translated to a regex that matches between two neighbouring characters of given classes and consumes none,
so Spark's split gives the units themselves and their concatenation is the text. Where a text is cut is a hash of its id.
Everything is a column expression; a text's units live in one row only while it is cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(kind: str = "(?s:.)") -> str:
    """Boundary between any two neighbours of a class: every character is a unit."""
    return f"(?<={kind})(?={kind})"


def behind(kind: str) -> str:
    """Boundary behind every run of a class: a unit is what stands before the run, and the run."""
    return f"(?<={kind})(?!{kind})(?=(?s:.))"


def runs(*kinds: str) -> str:
    """Boundary wherever the class changes: a unit is a run of one class, or of none of them. Classes are bracketed and share no character."""
    return "|".join(f"(?<={k})(?!{k})(?=(?s:.))|(?<!{k})(?={k})(?<=(?s:.))" for k in kinds)


#: Zero-width boundaries by the name of the unit. Java's lookbehind never ends within a surrogate pair, so a unit is whole code points.
GRAMMARS = {"code_point": each(), "word": behind(r"\s"), "line": behind(r"\n"), "sentence": behind(r"[.!?]"), "class": runs(r"\p{L}", r"\p{N}", r"\s")}

#: Control strings before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def units(text: Column, grammar: str = "code_point") -> Column:
    """The units of a text in order; a null or empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, GRAMMARS.get(grammar, grammar), -1)).otherwise(F.array().cast("array<string>"))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """An error unless texts without control strings stay apart from them: none may be empty, lie in another, or end as another begins."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j)))
            if not a or overlap or (i != j and a in b):
                raise ValueError(f"control strings {a!r} and {b!r} can run into each other")


def transform(docs: DataFrame, grammar: str = "code_point", plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs (doc_id, text).

    n is the number of units. The prefix ends after the smaller, the middle after the larger of two cuts from 0 to n, given by
    a hash of seed and doc_id; a null doc_id counts as an empty one, and rows that repeat are cut alike. form is plain (the
    text as it is) for plain_percent of the texts, for an empty or null text and for one that holds a control string; of the
    others spm_percent are spm (suffix, prefix, middle), the rest psm (prefix, suffix, middle). prefix_chars and middle_chars
    count code points and are null in plain form. Texts of any length are cut whole: about 100 bytes a unit while a row is
    worked on. Other columns of docs are passed over; an empty table gives no rows.
    """
    check_sentinels(sentinels)
    p, s, m = map(F.lit, sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    control = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    plain = (F.length("text") == 0) | control | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("units"), form.alias("form"), *(h[i].alias(f"h{i}") for i in range(2)))
    counted = cut.withColumn("n", F.size("units").cast("long"))
    first, second = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    placed = counted.select("doc_id", "text", "units", "form", "n", F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    piece = lambda begin, length: F.array_join(F.slice("units", begin, length), "")
    moved = placed.select(
        "doc_id", "text", "form", "n", piece(F.lit(1), F.col("a")).alias("prefix"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle")
    ).withColumn("suffix", F.substr("text", F.length("prefix") + F.length("middle") + 1))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    shown = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return moved.select("doc_id", "n", "form", shown("prefix").alias("prefix_chars"), shown("middle").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output in psm, spm or plain form was made from. Null for another form."""
    split = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    # one element, which binds the parts
    joined = lambda *order: F.transform(F.array(split), lambda p: F.concat(*(F.get(p, F.lit(i)) for i in order)))[0]
    return F.when(form == "plain", output).when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs, by code points."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
