"""One-permutation MinHash fingerprints with optimal densification, in DataFrame functions only.

The word 5-grams of a text are hashed once; the high bits of a hash name its bin, and a bin keeps its least hash. An empty
bin takes the value of a full one that a hash of the pair of bins picks at random, so equal sets pick alike whatever else
they hold. The low bits of each bin are stored side by side as hex, and the share of equal bins is corrected for those
that agree by chance.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

WORDS = 5
#: Bins (a power of two) and stored bits of each.
BINS, BITS = 128, 8
_SHIFT = 63 - (BINS.bit_length() - 1)


def ngram_hashes(text: Column, words: int = WORDS) -> Column:
    """Non-negative 63-bit hashes of the n-grams of the words that white space separates.

    A text of fewer words has one n-gram of all of them; one without words has none.
    """
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    each = F.transform(found, lambda w: F.xxhash64(w))
    positive = F.lit((1 << 63) - 1)

    def slide(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - words)
        return F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))).bitwiseAND(positive))

    # a one-element array binds the words' hashes, so that they are computed once
    one = F.when(F.size(found) > 0, F.array(F.xxhash64(F.array_join(found, " ")).bitwiseAND(positive))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(found) >= words, F.flatten(F.transform(F.array(each), slide))).otherwise(one)


def bin_values(hashes: Column) -> Column:
    """The stored bits of every bin, as an array of BINS numbers; all zero for a text without n-grams."""
    last = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _SHIFT).bitwiseOR(F.lit((1 << _SHIFT) - 1)))
    kept, mask = F.lit((1 << BITS) - 1).cast("long"), F.lit(-(1 << BITS)).cast("long")

    def first_of_bins(ordered: Column) -> Column:
        # the largest hash of each bin stands in it as a sentinel, so every bin has a first element
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT)))

    def densify(least: Column) -> Column:
        empty = lambda x: x.bitwiseAND(F.lit((1 << _SHIFT) - 1)) == (1 << _SHIFT) - 1  # noqa: E731  the sentinel

        def fill(full: Column) -> Column:
            def borrowed(b: Column) -> Column:
                drawn = F.transform(full, lambda x: F.xxhash64(b, F.shiftright(x, _SHIFT)).bitwiseAND(mask).bitwiseOR(x.bitwiseAND(kept)))
                return F.coalesce(F.array_min(drawn).bitwiseAND(kept), F.lit(0).cast("long"))

            return F.transform(least, lambda x, b: F.when(empty(x), borrowed(b)).otherwise(x.bitwiseAND(kept)))

        return F.flatten(F.transform(F.array(F.filter(least, lambda x: ~empty(x))), fill))

    ordered = F.array_sort(F.concat(hashes, last))
    least = F.flatten(F.transform(F.array(ordered), first_of_bins))
    return F.flatten(F.transform(F.array(least), densify))


def fingerprint(text: Column) -> Column:
    """Packed bins as a lower-case hex string. Equal texts have equal ones; a null counts as empty."""
    return F.lower(F.array_join(F.transform(bin_values(ngram_hashes(text)), lambda v: F.lpad(F.hex(v), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of the n-gram sets behind two fingerprints."""
    width = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substr(a, i * width + 1, F.lit(width)) == F.substr(b, i * width + 1, F.lit(width))).cast("int")
    )
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def _numbers(values: list) -> Column:
    """A constant array, however long, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>" if values and isinstance(values[0], list) else "array<bigint>")


def bounds_above(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are above x, by two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds) - 1) + 1
    pieces = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    piece = F.size(F.filter(_numbers([p[-1] for p in pieces]), lambda b: b <= x))  # pieces without a bound above x
    within = lambda k: F.lit(len(bounds)) - F.least(k * size, F.lit(len(bounds))) - F.coalesce(F.size(F.filter(F.get(_numbers(pieces), k), lambda b: b <= x)), F.lit(0))
    return F.get(F.transform(F.array(piece), within), F.lit(0))


def _ranges(docs: DataFrame, n: int) -> Column:
    """Number of the range of a row, in the order of (doc_id descending, nulls last, hash of the text); about n ranges of like size.

    An id that fills a range or more, null ids among them, has ranges of its own, which part its rows by the hash.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("cuts"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    seen = Counter(found["cuts"] or [])
    hot = {v: k for v, k in seen.items() if k > 1}
    bounds = sorted({*seen, *(v + 1 for v in hot)})
    nulls = max(1, math.ceil(found["none"] * n / max(found["rows"], 1)))
    # ranges from the highest ids down: range k holds ids below k bounds, the last one nulls
    parts = [hot.get(bounds[len(bounds) - 1 - k], 1) if k < len(bounds) else 1 for k in range(len(bounds) + 1)] + [nulls]
    starts = [0, *accumulate(parts)][:-1]
    own = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(bounds_above(F.col("doc_id"), bounds))
    share = F.xxhash64("text") / F.lit(2.0**64) + 0.5

    def placed(k: Column) -> Column:
        many = F.get(_numbers(parts), k)
        return F.get(_numbers(starts), k) + F.least(F.floor(share * many), many - 1)

    return F.get(F.transform(F.array(own), placed), F.lit(0)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """rng, doc_id, text, last, sorted into ranges of doc_id in descending order, each followed by the first row of the next range.

    last marks these repeated rows; the last range is followed by the very first row. Ties in doc_id are ordered by text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = docs.withColumn("rng", _ranges(docs, 4 * shuffle_partitions(docs.sparkSession)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("h"), F.col("text"))
    firsts = ranged.groupBy("rng").agg(F.min_by(F.struct("doc_id", "text"), order).alias("first"))
    ring = Window.orderBy("rng")  # one row per range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("rng", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("next"))
    repeated = following.select("rng", "next.doc_id", "next.text", F.lit(True).alias("last"))
    return ranged.select("rng", "doc_id", "text", F.lit(False).alias("last")).unionByName(repeated)


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text).

    The next document is the one that follows by descending doc_id, the first one after the last; ties follow by text, and
    rows with a null doc_id come last. A single row is its own next. A null text counts as empty; an empty table gives none.
    """
    dealt = with_next(docs).repartitionByRange("rng").withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("rng").orderBy("last", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    led = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w)).where(~F.col("last"))
    own = led.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return own.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
