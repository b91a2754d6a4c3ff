"""Choices as a stream: running counts, causal baselines with state per session, and a sink that keeps receipts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import SESSION
from ..sources.writers import receipts, write_tables


def running_counts(choices: DataFrame) -> DataFrame:
    """Choices per experiment and label so far."""
    return choices.groupBy("experiment", F.col("human_choice").alias("label")).agg(F.count("*").alias("n"))


SCORED = "experiment string, participant string, choice_index long, base_rate double, sticky double, bigram double"


def online_baselines(choices: DataFrame, k: int, smoothing: float = 0.5, time: str | None = None, late: str = "10 minutes", end: str | None = None, replay_ms: int = 600_000, idle_ms: int = 86_400_000) -> DataFrame:
    """Causal baselines of each choice as it arrives; k is the number of labels of the task.

    A batch's rows of a session are taken by choice_index, which counts from 0 without gaps. A row at or before the last one
    seen is a replay and is dropped, so a source may send rows again; a row beyond the next one means that a row came late
    and fails the query, since its score would lack what came before it. The state of a session is its counts.

    State ends where rows have a time, whose watermark lags by `late`. `end` names a boolean column that is true on a
    session's last choice: then only the session's length is kept, and nothing once the watermark is replay_ms past that
    choice; replays are dropped until then, later ones are late. A choice behind the last one fails the query. A session
    whose last row the watermark has passed by idle_ms is taken for ended and its state goes; should it go on, it must count
    from 0 again.
    """

    def score(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ended = False
        if state.exists:
            last, previous, seen, steps, repeats, one, two, lead, ended = json.loads(state.get[0])
        else:
            last, previous, seen, steps, repeats, one, two, lead = -1, None, 0, 0, 0, {}, {}, {}
        rows = pd.concat(list(batches)).sort_values("choice_index", kind="stable")
        marks = rows[end].fillna(False).astype(bool) if end else [False] * len(rows)
        out = []
        for index, label, mark in zip(rows["choice_index"], rows["human_choice"], marks, strict=True):
            if index <= last:
                continue
            if ended:
                raise ValueError(f"choice {index} of {key} comes after the session's end")
            if index != last + 1:
                raise ValueError(f"choice {last + 1} of {key} hasn't come before choice {index}")
            base = (one.get(label, 0) + smoothing) / (seen + smoothing * k)
            sticky = pair = 1.0 if k == 1 else base
            if previous is not None and k > 1:
                stays = (repeats + smoothing) / (steps + 2 * smoothing)
                sticky = stays if label == previous else (1 - stays) / (k - 1)
                pair = (two.get(f"{previous}\x1f{label}", 0) + smoothing) / (lead.get(previous, 0) + smoothing * k)
            out.append((*key, int(index), -math.log(base), -math.log(sticky), -math.log(pair)))
            if previous is not None:
                steps, repeats = steps + 1, repeats + (previous == label)
                two[f"{previous}\x1f{label}"] = two.get(f"{previous}\x1f{label}", 0) + 1
                lead[previous] = lead.get(previous, 0) + 1
            one[label], seen, previous, last, ended = one.get(label, 0) + 1, seen + 1, label, int(index), bool(mark)
        if ended:
            previous, seen, steps, repeats, one, two, lead = None, 0, 0, 0, {}, {}, {}
        state.update((json.dumps([last, previous, seen, steps, repeats, one, two, lead, ended]),))
        if time is not None:
            seen_at = int(rows[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(seen_at + (replay_ms if ended else idle_ms), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")])

    if end is not None and time is None:
        raise ValueError("an end marker needs a time, by which replays are told from a new session")
    rows, timer = (choices, GroupStateTimeout.NoTimeout) if time is None else (choices.withWatermark(time, late), GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy(*SESSION).applyInPandasWithState(score, SCORED, "counts string", "append", timer)


def ledger_sink(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write each micro-batch's predictions and receipts into a folder of its own; a batch that is tried again replaces its folder.

    A session that spans batches has a receipt in each; total_receipts adds them up.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # two tables come of it, and its state must move once
        try:
            write_tables({"predictions": batch, "receipts": receipts(batch)}, f"{path}/batch={number}", "overwrite")
        finally:
            batch.unpersist()

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def total_receipts(parts: DataFrame) -> DataFrame:
    """One receipt per session of the receipts of all batches: rows and rows per condition added up."""
    each = parts.select("schema", *SESSION, "status", "digest", F.explode("conditions").alias("condition", "n"))
    each = each.groupBy("schema", *SESSION, "status", "digest", "condition").agg(F.sum("n").alias("n"))
    rows = each.groupBy("schema", *SESSION, "status", "digest").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "n")))).alias("conditions"), F.sum("n").alias("prediction_rows"))
    return rows.select("schema", *SESSION, "status", "prediction_rows", "conditions", "digest")
