"""Scores of marked choices by a language model that is plugged in.

One pass over a cell's text scores every choice that it asks for. A cell is a target segment with as many segments before it
as a window shows, or a whole transcript; windows that show the same are one cell from the start, so nothing is asked twice
and nothing is joined back. Tokens carry character offsets, and a choice's tokens are those that its span overlaps in the
text as a whole, whatever a tokenizer merges across the marks.

    cells = window_cells(sessions, [0, 1, "full"], tx.anchor_targets)
    scored = score(prepare(cells, make, max_options=8), make, top_k=5)
    tables = shape_scores(choice_scores(scored), constants, keys)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import SESSION


@dataclass(frozen=True)
class Model:
    """A tokenizer and a scorer; a factory makes one per task, so it can hold weights of its own."""

    #: Text to (token id, start, end), places in code points, in the order of the text: a list, or an array of as many rows.
    encode: Callable[[str], list[tuple[int, int, int]] | np.ndarray]
    #: Token id to the text that it stands for, special tokens included.
    decode: Callable[[int], str]
    #: (ids, places) of a batch to, per request, the logits of the token at each place given the ids before it, in any iterable of rows.
    logits: Callable[[list[tuple[list[int], list[int]]]], Iterable[Iterable[np.ndarray]]]
    #: Put before every text where it isn't None.
    bos: int | None = None
    #: Texts of more tokens fail.
    most_tokens: int | None = None


Make = Callable[[], Model]

CELL = "asked array<struct<condition:string,window:int>>, effective_window int, first_choice int, targets array<int>"
PREPARED = f"{CELL}, support array<string>, ids array<int>, places array<array<int>>, choices array<string>, option_ids array<array<int>>, options_status string, tokens int"
TOPK = "array<struct<token_index:int,rank:int,token_id:int,token:string,logprob:double>>"
OPTIONS = "array<struct<option:string,logprob:double,n_tokens:int,is_human:boolean>>"
SCORE = (
    "struct<choice_index:int,target_index:int,human_choice:string,nll:double,num_tokens:int,pred_token_id:int,pred_choice:string,raw_generation:string,format_ok:boolean,k_options:int,"
    f"top_logprob:double,entropy:double,legal_mass:double,options_status:string,topk:{TOPK},options:{OPTIONS}>"
)
#: What tells a score from the others of its session.
SCORED = ["condition", "window", "target_index", "effective_window", "choice_index"]


def window_cells(sessions: DataFrame, windows: list[int | str], targets: Callable[[Column], Column]) -> DataFrame:
    """experiment, participant, asked, effective_window, first_choice, targets, base, text, support: one row per text to be read.

    sessions has text. windows are numbers of segments shown before a target, or "full": the whole transcript, read once for
    all of its choices (effective_window null). asked holds the conditions that the cell answers, targets the segment of each
    choice asked for, base the number of choices before them in the text, first_choice that in the session. support holds
    the labels of the whole session, whatever a window shows. Segments without a closed choice ask nothing.
    """
    t = F.col("text")
    support = F.array_sort(F.array_distinct(tx.choices(t)))
    cut = sessions.select(*SESSION, t.alias("whole"), tx.header(t).alias("header"), tx.segments(t).alias("segments"), support.alias("support")).where("segments is not null")
    cut = cut.withColumn("counts", F.transform("segments", lambda s: F.size(tx.choices(s))))
    total = lambda begin, length: F.aggregate(F.slice("counts", begin, length), F.lit(0), lambda a, b: a + b)
    entry = lambda name, w: F.struct(F.lit(name).alias("condition"), F.lit(w).cast("int").alias("window"))
    numbers = sorted({w for w in windows if w != "full"})
    parts = []
    if numbers:
        asked = F.array(*(entry(f"w{w}", w) for w in numbers))
        shown = lambda e: F.least(e["window"], F.col("target_index"))
        rows = cut.withColumn("target_index", F.explode(targets(F.size("segments")))).withColumn("effective_window", F.explode(F.array_distinct(F.transform(asked, shown))))
        first = F.col("target_index") - F.col("effective_window")
        parts.append(
            rows.select(
                *SESSION, F.filter(asked, lambda e: shown(e) == F.col("effective_window")).alias("asked"), "effective_window", total(F.lit(1), F.col("target_index")).alias("first_choice"),
                F.array_repeat("target_index", F.get("counts", "target_index")).alias("targets"), total(first + 1, F.col("effective_window")).alias("base"),
                tx.window_prompt(F.col("header"), F.col("segments"), F.col("target_index"), F.col("effective_window")).alias("text"), "support",
            )
        )
    if "full" in windows:
        places = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i, n)))
        parts.append(cut.select(*SESSION, F.array(entry("full", None)).alias("asked"), F.lit(None).cast("int").alias("effective_window"), F.lit(0).alias("first_choice"), places.alias("targets"), F.lit(0).alias("base"), F.col("whole").alias("text"), "support"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.size("targets") > 0)


#: Marked labels, as functions.text finds them.
MARKED = re.compile(r"(?s)<<(.*?)>>")
#: Rows of an Arrow batch that are turned into Python values together; it bounds what a task holds beside the batch.
ROWS = 256


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def token_table(encoded: list[tuple[int, int, int]] | np.ndarray, bos: int | None = None) -> np.ndarray:
    """A row (token id, start, end) per token, one put before them where bos isn't None."""
    table = encoded if isinstance(encoded, np.ndarray) else np.fromiter(chain.from_iterable(encoded), np.int64, 3 * len(encoded)).reshape(-1, 3)
    return table if bos is None else np.concatenate([[(bos, 0, 0)], table])


def overlapping(encoded: list[tuple[int, int, int]] | np.ndarray, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Places of the tokens that each span overlaps. Empty tokens overlap nothing, and the first token isn't predicted by any."""
    table = token_table(encoded)
    begins, ends, sides = table[:, 1], table[:, 2], np.array(spans, np.int64).reshape(-1, 2)
    some = begins < ends
    some = range(len(table)) if some.all() else np.flatnonzero(some)
    if not isinstance(some, range):
        begins, ends, some = begins[some], ends[some], some.tolist()
    low, high = ends.searchsorted(sides[:, 0], "right").tolist(), begins.searchsorted(sides[:, 1], "left").tolist()
    return [[k for k in some[a:b] if k > 0] for a, b in zip(low, high, strict=True)]


def values_of(array: pa.Array) -> list:
    """An Arrow array as Python values; nested lists are cut from one list of all their values, which to_pylist doesn't do."""
    if not pa.types.is_list(array.type):
        return array.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(array.type) and not array.null_count else array.to_pylist()
    offsets = np.asarray(array.offsets).tolist()
    inner = values_of(array.values.slice(offsets[0], offsets[-1] - offsets[0])) if len(array) else []
    out = [inner[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets, offsets[1:])]
    return [x if known else None for x, known in zip(out, array.is_valid().to_pylist(), strict=True)] if array.null_count else out


def lists_of(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of whole numbers as one list column of integers; a number beyond 32 bits fails."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()).cast(pa.int32()))


def option_tokens(model: Model, options: list[str], most: int) -> tuple[list[list[int]] | None, str]:
    """(token ids of each option as it stands behind the opening mark, status); no ids unless every option is one token."""
    if not most:
        return None, "off"
    if len(options) > most:
        return None, "too_many_options"
    ids = lambda text: [k for k, _, _ in model.encode(text)]
    mark, found = ids(tx.OPEN), []
    for option in options:
        own = ids(tx.OPEN + option)
        if own[: len(mark)] != mark:
            return None, "tokenization_mismatch"
        found.append(own[len(mark) :])
    return (found, "scored") if all(len(x) == 1 for x in found) else (None, "multi_token_option")


def prepare(cells: DataFrame, make: Make, max_options: int = 0) -> DataFrame:
    """cells as tokens: adds ids, places (of each choice's tokens), choices, option_ids, options_status, tokens; text and base go.

    Up to max_options labels of a session are told apart by single tokens; 0 leaves that out. A choice without tokens, a text
    beyond the model's length, and marks that don't fit the segments' fail the query.
    """

    def run(batches):
        model = make()
        known: dict[tuple, tuple] = {}
        for part in (part for batch in batches for part in slices(batch)):
            asked = pc.list_value_length(part.column("targets")).to_pylist()
            ids, places, choices, option_ids, statuses = [], [], [], [], []
            for text, base, n, support in zip(part.column("text").to_pylist(), values_of(part.column("base")), asked, values_of(part.column("support")), strict=True):
                spans = [m.span(1) for m in MARKED.finditer(text)]
                if len(spans) != base + n:
                    raise ValueError("the marks of a cell aren't those of its segments")
                encoded = token_table(model.encode(text), model.bos)
                if model.most_tokens is not None and len(encoded) > model.most_tokens:
                    raise ValueError(f"a text has {len(encoded)} tokens, the model takes {model.most_tokens}")
                spans = spans[base:]
                own = overlapping(encoded, spans)
                if not all(own):
                    raise ValueError("a choice has no tokens")
                if (key := tuple(support)) not in known:
                    known = {key: option_tokens(model, support, max_options)}  # a session's cells come one after the other
                ids.append(encoded[:, 0])
                places.append(own)
                choices.append([text[a:b] for a, b in spans])
                option_ids.append(known[key][0])
                statuses.append(known[key][1])
            made = {"ids": lists_of(ids), "places": places, "choices": choices, "option_ids": option_ids, "options_status": statuses, "tokens": [len(x) for x in ids]}
            columns = [part.column(f.name) if f.name in kept else made[f.name] for f in schema]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    kept = [*SESSION, "asked", "effective_window", "first_choice", "targets", "support"]
    ddl = ", ".join(f"{c} {t}" for c, t in cells.dtypes if c in SESSION) + f", {PREPARED}"
    schema = arrow_schema(ddl)
    return cells.select(*kept[:-1], "base", "text", "support").mapInArrow(run, ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batches_of(rows: Iterable[dict], budget: int) -> Iterator[list[dict]]:
    """Rows, longest first, in batches: the first one's tokens times the number of rows stays within the budget, or it is one row."""
    held: list[dict] = []
    for row in rows:
        if held and held[0]["tokens"] * (len(held) + 1) > budget:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


#: Places whose logits are looked at together; it bounds what a task holds besides the scorer's own.
PLACES = 64
#: Vocabularies up to this size are sorted whole for the top tokens.
SORTED = 4_096


def likeliest(logprobs: np.ndarray, k: int) -> np.ndarray:
    """The k largest places of each row, the least place first on ties."""
    k = min(k, logprobs.shape[1])
    if k and logprobs.shape[1] > SORTED:
        least = np.partition(-logprobs, k - 1, axis=1)[:, k - 1]
        some = [np.flatnonzero(-row <= x) for row, x in zip(logprobs, least, strict=True)]
        return np.array([at[np.argsort(-row[at], kind="stable")[:k]] for row, at in zip(logprobs, some, strict=True)])
    return np.argsort(-logprobs, axis=1, kind="stable")[:, :k] if k else np.zeros((len(logprobs), 0), int)


def read_places(logits: np.ndarray, tokens: list[int], options: list[list[list[int]] | None], top_k: int) -> Iterator[tuple]:
    """What is kept of each place: the token's log-probability, the likeliest token (the least id on ties), its log-probability, entropy, top tokens and their log-probabilities, those of the options."""
    logits = np.asarray(logits, float)
    if not np.isfinite(logits).all():
        raise ValueError("a scorer must give finite logits")
    top = logits.max(axis=1, keepdims=True)
    logprobs = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    rows, best = np.arange(len(logits)), logprobs.argmax(axis=1)
    entropy = -(np.exp(logprobs) * logprobs).sum(axis=1)
    order = likeliest(logprobs, top_k)
    values = np.take_along_axis(logprobs, order, 1).tolist()
    chosen = [None if o is None else logprobs[k, [x[0] for x in o]].tolist() for k, o in enumerate(options)]
    return zip(logprobs[rows, tokens].tolist(), best.tolist(), logprobs[rows, best].tolist(), entropy.tolist(), order.tolist(), values, chosen, strict=True)


def read_cells(model: Model, cells: list[dict], top_k: int) -> Iterator[tuple[dict, dict[int, tuple]]]:
    """Each cell of a batch with what is kept of its places; places of several cells are read at once."""
    places = [sorted({i for own in cell["places"] for i in own}) for cell in cells]
    answers = model.logits([(cell["ids"], p) for cell, p in zip(cells, places, strict=True)])
    seen: list[dict[int, tuple]] = []
    held: list[tuple] = []

    def read():
        found = read_places(np.stack([x for *_, x in held]), [cells[n]["ids"][i] for n, i, _ in held], [cells[n]["option_ids"] for n, *_ in held], top_k)
        for (n, i, _), kept in zip(held, found, strict=True):
            seen[n][i] = kept
        held.clear()

    for n, (answer, wanted) in enumerate(zip(answers, places, strict=True)):
        seen.append({})
        answer = iter(answer)
        for begin in range(0, len(wanted), PLACES):
            part = wanted[begin : begin + PLACES]
            if len(held) + len(part) > PLACES:
                read()
            logits = list(islice(answer, len(part)))
            if len(logits) < len(part):
                raise ValueError("a scorer must give logits for every place")
            held.extend((n, i, x) for i, x in zip(part, logits, strict=True))
    if held:
        read()
    return zip(cells, seen, strict=True)


#: Columns of a score in their order, before topk and options.
FLAT = SCORE.removeprefix("struct<").split(",topk:")[0]
#: Scores that a task holds before it hands them on; one batch of cells may add more.
HELD = 2_048


class Scores:
    """Scores of cells as flat columns, which become one Arrow batch."""

    def __init__(self, passed: list[str]):
        self.passed = passed
        self.names = [c.partition(":")[0] for c in FLAT.split(",")]
        self.clear()

    def clear(self) -> None:
        self.cells: list[tuple[pa.RecordBatch, int]] = []  # the slice that a cell is from, and its place there
        self.sizes: list[int] = []
        self.rows: list[tuple] = []
        self.top: list[tuple] = []
        self.top_sizes: list[int] = []
        self.options: list[tuple] = []
        self.option_sizes: list[int] = []

    def add(self, cell: dict, seen: dict[int, tuple], decode: Callable[[int], str]) -> None:
        ids, support, own_options, known = cell["ids"], cell["support"], cell["option_ids"], set(cell["support"])
        self.cells.append(cell["passed"])
        self.sizes.append(len(cell["choices"]))
        for k, (choice, own) in enumerate(zip(cell["choices"], cell["places"], strict=True)):
            _, best, best_logprob, entropy, _, _, chosen = seen[own[0]]
            status, mass, n_options = cell["options_status"], None, 0
            if own_options is not None:
                # comparable only where the text holds the very tokens that the options were built from
                if [ids[i] for i in own] == own_options[support.index(choice)]:
                    self.options.extend((o, v, 1, o == choice) for o, v in zip(support, chosen, strict=True))
                    n_options, mass = len(support), float(np.exp(chosen).sum()) if support else None
                else:
                    status = "tokenization_mismatch"
            said = decode(best)
            before = len(self.top)
            for n, i in enumerate(own):
                self.top.extend((n, r, t, decode(t), v) for r, (t, v) in enumerate(zip(seen[i][4], seen[i][5], strict=True)))
            self.top_sizes.append(len(self.top) - before)
            self.option_sizes.append(n_options)
            self.rows.append(
                (cell["first_choice"] + k, cell["targets"][k], choice, -sum(seen[i][0] for i in own), len(own), best, said, said, said in known, len(support), best_logprob, entropy, mass, status)
            )

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        def struct(rows: list[tuple], fields: list[pa.Field], more: tuple = ()) -> pa.StructArray:
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) - len(more))
            return pa.StructArray.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)), *more], fields=fields)

        def listed(sizes: list[int], values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

        score = schema.field("scores").type.value_type
        inner = {score.field(k).name: score.field(k).type.value_type for k in range(len(self.names), score.num_fields)}
        nested = [listed(sizes, struct(rows, list(inner[name]))) for name, sizes, rows in (("topk", self.top_sizes, self.top), ("options", self.option_sizes, self.options))]
        nested = [n.cast(score.field(len(self.names) + k).type) for k, n in enumerate(nested)]
        scores = listed(self.sizes, struct(self.rows, list(score), tuple(nested))).cast(schema.field("scores").type)
        runs = [self.cells[a][0].slice(self.cells[a][1], b - a) for a, b in self.runs()]
        columns = [pa.concat_arrays([r.column(c).cast(schema.field(c).type) for r in runs]) for c in self.passed]
        self.clear()
        return pa.RecordBatch.from_arrays([*columns, scores], names=schema.names)

    def runs(self) -> Iterator[tuple[int, int]]:
        """First place and end of the cells that come from the same slice."""
        begin = 0
        for k in range(1, len(self.cells) + 1):
            if k == len(self.cells) or self.cells[k][0] is not self.cells[begin][0]:
                yield begin, k
                begin = k


#: Columns of a prepared cell that are read here.
READ = ["first_choice", "targets", "support", "ids", "places", "choices", "option_ids", "options_status", "tokens"]


def cells_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch of prepared cells, with passed: the slice that holds the other columns and the row's place there."""
    for part in slices(batch):
        for k, row in enumerate(zip(*(values_of(part.column(c)) for c in READ), strict=True)):
            yield {**dict(zip(READ, row, strict=True)), "passed": (part, k)}


def score(prepared: DataFrame, make: Make, budget: int = 4096, top_k: int = 0) -> DataFrame:
    """experiment, participant, asked, effective_window, scores of every prepared cell.

    scores has one entry per choice: nll is summed over the choice's tokens; pred_choice is the likeliest first token as text
    and format_ok says that this text is a label of the session, so of a label of several tokens the first one isn't one.
    options are there where options_status is scored. Each partition is sorted by length and packed longest first, over
    however many Arrow batches, so a task holds one batch of `budget` tokens; how cells fall into batches changes no result.
    """
    passed = [c for c in prepared.columns if c in (*SESSION, "asked", "effective_window")]
    kinds = dict(prepared.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in passed) + f", scores array<{SCORE}>"
    schema = arrow_schema(ddl)

    def run(batches):
        model, scores = make(), Scores(passed)
        decode = cache(model.decode)
        for held in batches_of((cell for batch in batches for cell in cells_of(batch)), budget):
            for cell, seen in read_cells(model, held, top_k):
                scores.add(cell, seen, decode)
            if len(scores.rows) >= HELD:
                yield scores.batch(schema)
        if scores.sizes:
            yield scores.batch(schema)

    return prepared.sortWithinPartitions(F.desc("tokens"), *SESSION).mapInArrow(run, ddl)


def choice_scores(scored: DataFrame) -> DataFrame:
    """One row per choice and condition that asked for it: condition, window (null: full), target_index, effective_window and the entries of its score, topk and options nested."""
    each = scored.select(*SESSION, F.explode("asked").alias("a"), "effective_window", "scores").select(*SESSION, "a.*", "effective_window", F.explode("scores").alias("s"))
    return each.select(*SESSION, "condition", "window", F.coalesce("effective_window", "s.target_index").alias("effective_window"), "s.*")


def choice_tokens(sessions: DataFrame, make: Make) -> DataFrame:
    """experiment, participant, choice_index, first_token, num_tokens of every marked choice, by the tokens of the whole transcript, one put before it included.

    A session without marks has no rows; a choice without tokens fails the query.
    """

    def run(batches):
        model = make()
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for session in part.to_pylist():
                spans = [m.span(1) for m in MARKED.finditer(session["text"] or "")]
                places = overlapping(token_table(model.encode(session["text"]), model.bos), spans) if spans else []
                if not all(places):
                    raise ValueError("a choice has no tokens")
                rows += [{**{c: session[c] for c in SESSION}, "choice_index": k, "first_token": own[0], "num_tokens": len(own)} for k, own in enumerate(places)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = ", ".join(f"{c} {t}" for c, t in sessions.dtypes if c in SESSION) + ", choice_index int, first_token int, num_tokens int"
    schema = arrow_schema(ddl)
    return sessions.select(*SESSION, "text").mapInArrow(run, ddl)


def tokenized(sessions: DataFrame, make: Make) -> DataFrame:
    """sessions with ids and tokens (start, end) of their text in place of it. A null text has none."""

    def run(batches):
        model = make()
        for part in (part for batch in batches for part in slices(batch)):
            # numbers go from the tokenizer to Arrow as arrays: a slice's tokens are never Python objects together
            found = [token_table([]) if text is None else token_table(model.encode(text), model.bos) for text in part.column(len(kept)).to_pylist()]
            ids, starts, ends = (lists_of([x[:, k] for x in found]) for k in range(3))
            tokens = pa.ListArray.from_arrays(starts.offsets, pa.StructArray.from_arrays([starts.values, ends.values], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], part.column(len(kept) + 1), ids, tokens], names=schema.names)

    kept = [c for c in sessions.columns if c not in ("text", "spans", "ids", "tokens")]
    kinds = dict(sessions.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", spans array<struct<start:int,end:int>>, ids array<int>, tokens array<struct<start:int,end:int>>"
    schema = arrow_schema(ddl)
    return sessions.select(*(F.col(f"`{c}`") for c in kept), "text", tx.span_places(F.col("text")).alias("spans")).mapInArrow(run, ddl)
