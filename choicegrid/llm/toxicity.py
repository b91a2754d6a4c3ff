"""Toxicity by a noisy channel: restore disguised words first, then score the restored text.

A writer hides a word by look-alike symbols, by spaces or marks between its letters, or by repeated letters. Each such
spelling is a lattice: every symbol may stand for itself or for letters, marks and repeats may be dropped. Viterbi decoding
under a character language model counted over the whole corpus finds the likeliest letters. A spelling without a repeat, a
symbol or a mark has a lattice of one path and is its own decoding, so only the others are decoded, once per distinct spelling.
Digits alone are a spelling like any other, so a number is read as the likeliest letters or digits.
Single characters that stand apart, in runs of any length, are one lattice, and so are neighbouring words that together
spell a word that counts as evidence; the space between them is one more mark that may be dropped.

The score looks for words of restored text, and beginnings of words, that labelled toxic documents hold and others don't.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, filter_rows, held_out, materialize
from .tokens import slices
from .training import TRAIN_ROWS, Logistic, labelled_rows, with_labels

#: The letters that a symbol may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "§": "s", "*": "aeiou", "?": "aeiou",
}
#: Marks that may stand between the letters of one word.
MARKS = ".-_~'·,/"
#: Bits of the language model's tables of one, two and three characters. Every letter of every script is counted, by a hash.
TABLES = (16, 18, 21)
SLICE = 4_000_000
#: Logarithms of the channel's probabilities.
DROP_MARK, DROP_EDGE, DROP_REPEAT, SUBSTITUTE, KEEP_SYMBOL, KEEP_REPEAT, DROP_SPACE = (math.log(p) for p in (0.5, 0.3, 0.3, 0.3, 0.02, 0.3, 0.05))
_MASK, _FACTORS, _MIX = (1 << 32) - 1, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 0x27D4EB2F


def _place(codes, bits: int):
    """Where a table counts an n-gram of code points, which are numbers or arrays of 32-bit ones."""
    value = 0
    for c, k in zip(codes, _FACTORS, strict=False):
        value = (value + c * k) & _MASK
    return (((value ^ (value >> 15)) * _MIX) & _MASK) >> (32 - bits)


class CharModel:
    """Trigrams of lower-case letters with interpolated lower orders. Codes: 0 word edge, 1 other, else the letter's code point."""

    def __init__(self, one: np.ndarray, two: np.ndarray, three: np.ndarray):
        self.one, self.two, self.three, self.all = one, two, three, float(one.sum())
        self.known: dict[str, str] = {}
        self.regions: dict[str, str] = {}
        self.logs: dict[tuple[str, str, str], float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        """Logarithm of the probability of c after a and b; "" and " " are a word's edge."""
        found = self.logs.get((a, b, c))
        if found is None:
            if len(self.logs) >= KEPT_SPELLINGS:
                self.logs.clear()
            x, y, z = (0 if k in ("", " ") else ord(k) if k.isalpha() else 1 for k in (a, b, c))
            p1 = (self.one[_place((z,), TABLES[0])] + 1) / (self.all + (1 << TABLES[0]))
            p2 = (self.two[_place((y, z), TABLES[1])] + 5 * p1) / (self.one[_place((y,), TABLES[0])] + 5)
            p3 = (self.three[_place((x, y, z), TABLES[2])] + 5 * p2) / (self.two[_place((x, y), TABLES[1])] + 5)
            # hashes that meet may count more of an n-gram than of what it begins with
            found = self.logs[(a, b, c)] = math.log(min(p3, 1.0))
        return found


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter's, 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            table[k] = ord(c.lower()) if len(c.lower()) == 1 else k
    return table


def char_model(docs: DataFrame) -> CharModel:
    """Model of all texts of docs, by one pass; a task sends its counts, at most one row for each place of the tables."""
    begins = np.concatenate([[0], np.cumsum([1 << b for b in TABLES])])

    def count(batches):
        table, total = _lower_letters(), np.zeros(begins[-1], np.int64)
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                data = np.frombuffer(" ".join(["", *pc.fill_null(batch.column(0), "").to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = table[data]
                codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]  # one edge between words
                for k, bits in enumerate(TABLES):
                    if len(codes) > k:
                        places = _place([codes[i : len(codes) - k + i] for i in range(k + 1)], bits).astype(np.int64)
                        total[begins[k] : begins[k + 1]] += np.bincount(places, minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # as many rows as places at most
    counts = np.zeros(begins[-1], np.float32)
    counts[np.asarray(rows["gram"])] = np.asarray(rows["n"])
    return CharModel(*(counts[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)))


def lattice(spelling: str) -> list[list[tuple[str, float]]]:
    """What each character of a spelling (lower case) may stand for, and the logarithm of that choice's probability.

    Symbols before the first letter or digit, or after the last, may be dropped; a space may too.
    """
    solid = [i for i, c in enumerate(spelling) if c.isalnum()] or [len(spelling)]
    out, before = [], ""
    for i, c in enumerate(spelling):
        arcs: list[tuple[str, float]] = []
        if c == " ":
            arcs = [(" ", 0.0), ("", DROP_SPACE)]
        elif c.isalpha():
            arcs.append((c, KEEP_REPEAT if c == before else 0.0))
            if c == before:
                arcs.append(("", DROP_REPEAT))
        else:
            arcs.extend((x, SUBSTITUTE) for x in LOOKALIKE.get(c, ""))
            if c in MARKS:
                arcs.append(("", DROP_MARK))
            elif not solid[0] <= i <= solid[-1]:
                arcs.append(("", DROP_EDGE))
            arcs.append((c, KEEP_SYMBOL))
            if c == before:
                arcs.append(("", DROP_REPEAT))
        out.append(arcs)
        before = c
    return out


def best_path(spelling: str, model: CharModel, spaced: bool = False) -> tuple[float, str]:
    """(score, letters) of the likeliest path through the lattice, whose states are the last two letters.

    spaced: the spelling is a run of single characters that stood apart, so an edge between words may stand before each of
    them.
    """
    log = model.log
    states: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
    for arcs in lattice(spelling):
        following: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for x, cost in arcs:
                if x:
                    key, value, way = (b, x), score + cost + log(a, b, x), (path, x)
                else:
                    key, value, way = (a, b), score + cost, path
                if key not in following or following[key][0] < value:
                    following[key] = (value, way)
                if spaced and x and b:
                    edge = score + cost + log(a, b, " ") + log(b, " ", x) + DROP_MARK
                    if (" ", x) not in following or following[(" ", x)][0] < edge:
                        following[(" ", x)] = (edge, ((path, " "), x))
        states = following
    score, _, path = max((value + log(a, b, " "), (a, b), path) for (a, b), (value, path) in states.items())
    out = []
    while path:
        path, x = path
        out.append(x)
    return score, "".join(reversed(out))


#: What has a choice: a letter after itself, and what isn't a letter.
_CHOICES = re.compile(r"(?:(?<=(.))\1|[\W\d_])+", re.DOTALL)


def _best_region(before: str, region: str, after: str, ends: bool, model: CharModel) -> str:
    """What region says between the letters before and after it; ends says that the word ends behind after."""
    log = model.log
    states: dict[tuple[str, str], tuple[float, str]] = {(before[-2] if len(before) > 1 else "", before[-1:]): (0.0, "")}
    for arcs in [*lattice(before + region + after)[len(before) : len(before) + len(region)], *([(c, 0.0)] for c in after)]:
        following: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (score, said) in states.items():
            for x, cost in arcs:
                key, value = ((b, x), score + cost + log(a, b, x)) if x else ((a, b), score + cost)
                if key not in following or following[key][0] < value:
                    following[key] = (value, said + x)
        states = following
    best = max((value + (log(a, b, " ") if ends else 0.0), (a, b), said) for (a, b), (value, said) in states.items())[2]
    return best[: len(best) - len(after)]


def decode(spelling: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest letters of a spelling (lower case).

    The model sees two letters before and behind a choice, so parts of a word between which two letters stand that leave no
    choice are decided apart. Such decisions recur between words and are remembered.
    """
    if spaced or " " in spelling:
        return best_path(spelling, model, spaced)[1]
    regions: list[list[int]] = []
    for m in _CHOICES.finditer(spelling):
        if regions and m.start() - regions[-1][1] < 2:
            regions[-1][1] = m.end()
        else:
            regions.append([m.start(), m.end()])
    out, at = [], 0
    for begin, end in regions:
        before, region, after = spelling[max(0, begin - 2) : begin], spelling[begin:end], spelling[end : end + 2]
        if not (spelling[at:begin] + after + "a").isalpha():  # a numeral that is neither digit nor letter
            return best_path(spelling, model)[1]
        ends = end + len(after) == len(spelling) and len(after) < 2
        key = f"{before}\0{region}\0{after}\0{ends}"
        said = model.regions.get(key)
        if said is None:
            if len(model.regions) >= KEPT_SPELLINGS:
                model.regions.clear()
            said = model.regions[key] = _best_region(before, region, after, ends, model)
        out.append(spelling[at:begin] + said)
        at = end
    if not (spelling[at:] + "a").isalpha():
        return best_path(spelling, model)[1]
    return "".join([*out, spelling[at:]])


_SYMBOLS = "".join(re.escape(c) for c in [*LOOKALIKE, *MARKS] if not c.isalnum())
#: What no lattice reads as a letter, at a spelling's ends.
_EDGE = rf"^[^\pL\pN{_SYMBOLS}]+|[^\pL\pN{_SYMBOLS}]+$"
#: A repeated neighbour, or a symbol or mark that may stand for something else.
_CHOICE = re.compile(rf"(?s:.*?)(?:(.)\1|[0-9{_SYMBOLS}])", re.DOTALL)
#: Decoded spellings that a Python worker keeps; it changes no result.
KEPT_SPELLINGS = 500_000


def decoded(spelling: str, model: CharModel, spaced: bool = False) -> str:
    key = f"\0{spelling}" if spaced else spelling
    known = model.known.get(key)
    if known is None:
        if len(model.known) >= KEPT_SPELLINGS:
            model.known.clear()
        known = model.known[key] = decode(spelling, model, spaced)
    return known


def restore(texts: pa.Array, model: CharModel) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words of restored text, code of each word in order, first word's place of each text and the end).

    What holds neither letter nor digit nor symbol is no word, so characters of a run may stand any number of spaces apart.
    """
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    for mark in "\n\t\r":
        low = pc.replace_substring(low, mark, " ")
    parts = pc.split_pattern(low, " ")
    coded = pc.dictionary_encode(parts.flatten())
    ends = np.asarray(parts.offsets, np.int64)
    ends = ends - ends[0]
    core = pc.replace_substring_regex(coded.dictionary, _EDGE, "")
    # a mark at the end is always dropped: whatever else the text has, "other" is the rarest of all codes
    core = pc.replace_substring_regex(core, rf"[{re.escape(MARKS)}]+$", "")
    length = np.asarray(pc.utf8_length(core), np.int64)
    single = length == 1
    spelled = core.to_pylist()
    words = [decoded(w, model) if _CHOICE.match(w) else w for w in spelled]
    codes = np.asarray(coded.indices, np.int64)
    some = length[codes] > 0
    ends = np.concatenate([[0], np.cumsum(some)])[ends]
    codes = codes[some]
    # runs of single characters within a text
    alone = single[codes].astype(np.int8)
    bounds = np.zeros(len(codes) + 1, bool)
    bounds[ends] = True
    starts = np.flatnonzero(alone & ~(np.concatenate([[0], alone[:-1]]).astype(bool) & ~bounds[:-1]))
    stops = np.flatnonzero(alone & ~(np.concatenate([alone[1:], [0]]).astype(bool) & ~bounds[1:])) + 1
    extra_words, extra_at = [], []
    for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
        if e - s >= 2:
            run = "".join(spelled[c] for c in codes[s:e].tolist())
            said = decoded(run, model, spaced=True).split(" ")
            extra_words.extend([*said, "".join(said)] if len(said) > 1 else said)
            extra_at.extend([s] * (len(said) + (len(said) > 1)))
    if extra_words:  # a restored run is read beside the characters it is made of
        codes = np.insert(codes, extra_at, len(words) + np.arange(len(extra_words)))
        ends = ends + np.searchsorted(np.array(extra_at), ends, "left")
    return pa.array(words + extra_words, pa.large_string()), codes, ends


#: Features: whole words, and their first letters (words of one family share them).
PREFIXES = (3, 4, 5, 6)
#: A feature needs so many toxic documents, whatever the table's size, and such a weight.
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
#: Features that a task counts before it hands them on.
COUNTED = 500_000


def word_features(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes of the features of each word, one column per kind and -1 for none; the features' names)."""
    mark, none = pa.scalar("=", pa.large_string()), pa.scalar("", pa.large_string())
    kinds = [pc.binary_join_element_wise(mark, words, none)]
    kinds += [pc.if_else(pc.greater(pc.utf8_length(words), k), pc.utf8_slice_codeunits(words, 0, k), None) for k in PREFIXES]
    table = pa.concat_arrays([k.cast(pa.large_string()) for k in kinds])
    coded = pc.dictionary_encode(table)
    codes = np.asarray(pc.fill_null(coded.indices, -1), np.int64).reshape(len(kinds), -1).T
    return codes, coded.dictionary


def doc_pairs(codes: np.ndarray, ends: np.ndarray, per_word: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, of wanted features only."""
    counts = np.diff(ends)
    docs = np.repeat(np.arange(len(counts)), counts)
    hit = np.where(per_word >= 0, wanted[per_word], -1)  # word x kind
    some = (hit >= 0).any(axis=1)[codes]
    docs, rows = docs[some], hit[codes[some]]
    docs = np.repeat(docs, rows.shape[1])[rows.ravel() >= 0]
    rows = rows.ravel()[rows.ravel() >= 0]
    if not len(rows):
        return docs, rows
    pairs = distinct(docs * (int(rows.max()) + 1) + rows)
    return pairs // (int(rows.max()) + 1), pairs % (int(rows.max()) + 1)


class Model:
    """Weights of features and the calibration of what a document shows of them."""

    def __init__(self, chars: CharModel, names: pa.Array, weights: np.ndarray, calibration: Logistic | None, base: float):
        self.chars, self.names, self.weights, self.calibration, self.base = chars, names, weights, calibration, base
        whole = [(n[1:], w) for n, w in zip(names.to_pylist(), weights.tolist(), strict=True) if n.startswith("=")]
        self.whole = dict(whole)
        self.heads = {w[:k] for w, _ in whole for k in range(1, len(w))}
        self.begins = pa.array(sorted(self.heads), pa.large_string())
        self.insides = pa.array(sorted({w[i:j] for w, _ in whole for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)}), pa.large_string())

    def joined(self, words: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, weights) of neighbouring words, two or more, that spell a word of the model together, where the decoder drops their spaces.

        Single characters that stand apart are such words too, so a run of them holds a word of the model wherever that begins
        and ends in it.
        """
        first, inside = (np.asarray(pc.is_in(words, value_set=v), bool) for v in (self.begins, self.insides))
        at = np.flatnonzero(first[codes[:-1]] & inside[codes[1:]])
        at = at[~np.isin(at + 1, ends)]
        # pairs recur: what two words begin is looked up once
        pairs, where = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
        begun = [words[k // len(words)].as_py() + words[k % len(words)].as_py() for k in pairs.tolist()]
        going = np.array([w in self.heads or w in self.whole for w in begun], bool)
        docs, weights = [], []
        at, where = at[going[where]], where[going[where]]
        for k, pair, doc in zip(at.tolist(), where.tolist(), (np.searchsorted(ends, at, "right") - 1).tolist(), strict=True):
            said, pieces, stop = begun[pair], [words[int(codes[k])].as_py(), words[int(codes[k + 1])].as_py()], int(ends[doc + 1])
            while True:
                weight = self.whole.get(said)
                if weight is not None and self.drops_spaces(pieces, said):
                    docs.append(doc)
                    weights.append(weight)
                if said not in self.heads or k + len(pieces) >= stop:
                    break
                pieces.append(words[int(codes[k + len(pieces)])].as_py())
                said += pieces[-1]
        return np.array(docs, int), np.array(weights, float)

    def drops_spaces(self, pieces: list[str], said: str) -> bool:
        """Whether the decoder reads the pieces as one word: single characters as a run, whose letters count without its edges, others as one lattice with spaces."""
        if all(len(p) == 1 for p in pieces):
            return decoded(said, self.chars, spaced=True).replace(" ", "") == said
        return decoded(" ".join(pieces), self.chars) == said

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: the largest weight of a feature that it has, and the second one; 0 where there is none.

        Neither depends on the text's length: a long text with one toxic word is toxic.
        """
        words, codes, ends = restore(texts, self.chars)
        out = np.zeros((len(ends) - 1, 2))
        if not len(self.names):
            return out
        per_word, names = word_features(words)
        place = np.asarray(pc.fill_null(pc.index_in(names, value_set=self.names), -1), np.int64)
        docs, features = doc_pairs(codes, ends, per_word, place)
        more, added = self.joined(words, codes, ends)
        docs, weights = np.concatenate([docs, more]), np.concatenate([self.weights[features], added])
        order = np.lexsort((-weights, docs))
        docs, weights = docs[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, int)
        out[docs[first], 0] = weights[first]
        second = first + 1
        ok = second < len(docs)
        ok[ok] = docs[second[ok]] == docs[first[ok]]
        out[docs[first[ok]], 1] = weights[second[ok]]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.base)
        return self.calibration.proba(self.evidence(texts))


def copy_key(text) -> F.Column:
    """The same for copies of a text, near ones mostly: its eight least word hashes."""
    least = F.slice(F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), " "), lambda w: F.xxhash64(w)))), 1, 8)
    return F.xxhash64(least)


def fit(docs: DataFrame, labels: DataFrame, keep_held_out: bool = False, most: int = TRAIN_ROWS, least_docs: int = LEAST_DOCS, least_weight: float = LEAST_WEIGHT) -> Model:
    """Learn from at most about `most` labelled rows; one document of a group of copies counts. docs has doc_id and text.

    The labelled rows are written once and read again. Without toxic or without clean rows every text gets the share of
    toxic rows (0 where nothing is labelled) as its score. A feature counts from least_docs toxic documents on, if its weight
    is above least_weight.
    """
    chars = char_model(docs)
    spark = docs.sparkSession
    labelled = materialize(with_labels(docs.select("doc_id", "text"), labelled_rows(labels, "toxic", keep_held_out, most)).withColumn("copy", copy_key(F.col("text"))))
    chosen = labelled.groupBy("copy", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label").toArrow()
    n_toxic = int(pc.sum(chosen["label"]).as_py() or 0)
    n_clean = chosen.num_rows - n_toxic
    none = Model(chars, pa.array([], pa.large_string()), np.zeros(0), None, n_toxic / max(chosen.num_rows, 1))
    if not n_toxic or not n_clean:
        return none
    rows = spark.createDataFrame(chosen.to_pandas(), "doc_id long, label int")  # at most `most` rows
    train = with_labels(labelled.select("doc_id", "text"), rows).select("doc_id", "text", "label")
    held = spark.sparkContext.broadcast(chars)

    def features(batches):
        total: dict[str, list[int]] = {}

        def handed():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), *(pa.array([n[k] for n in total.values()], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"]
            )
            total.clear()
            return rows

        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                labels = np.asarray(batch.column(2), np.int64)
                words, codes, ends = restore(batch.column(1), held.value)
                per_word, names = word_features(words)
                docs, found = doc_pairs(codes, ends, per_word, np.arange(len(names)))
                toxic = np.bincount(found[labels[docs] == 1], minlength=len(names))
                clean = np.bincount(found[labels[docs] == 0], minlength=len(names))
                for name, c, t in zip(names.to_pylist(), clean.tolist(), toxic.tolist(), strict=True):
                    n = total.setdefault(name, [0, 0])
                    n[0] += c
                    n[1] += t
                if len(total) >= COUNTED:
                    yield handed()
        yield handed()

    # the share of toxic documents among those with the feature, drawn towards the base rate by one document
    base = n_toxic / chosen.num_rows
    counted = train.mapInArrow(features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") + base) / (F.col("clean") + (1 - base))
    weighed = counted.where(F.col("toxic") >= least_docs).select("feature", (F.log(odds) - math.log(base / (1 - base))).alias("weight"))
    good = weighed.where(F.col("weight") > least_weight).orderBy(F.desc("weight"), "feature").toArrow()  # bounded by the sample
    if not good.num_rows:
        return none
    model = Model(chars, good["feature"].combine_chunks().cast(pa.large_string()), np.asarray(good["weight"]), None, base)
    held_model = spark.sparkContext.broadcast(model)

    def shown(batches):
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                e = held_model.value.evidence(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["label", "a", "b"])

    seen = train.mapInArrow(shown, "label int, a double, b double").toArrow()  # at most `most` rows
    model.calibration = Logistic(0.01).fit(np.column_stack([np.asarray(seen[k]) for k in "ab"]), np.asarray(seen["label"], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row of docs (doc_id, text). A null text counts as empty; repeated rows are scored each."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, budget=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score is below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def decide(whole):
        return np.concatenate([np.zeros(0), *(held.value.score(batch.column(0)) for batch in slices(whole, budget=SLICE))]) < threshold

    return filter_rows(docs, [F.col("text")], decide)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); learned outside the held-out fold."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
