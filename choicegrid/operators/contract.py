"""What the manifests of a sharded run must state, and the rows that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .protocol import run_contract

#: Names of the window suite and of its grids of positions, with the number of positions that a grid asks for.
WINDOW_SUITE = "e3"
GRIDS = {"even": None, "e0-informed": 5}


class ContractError(ValueError):
    """A manifest that lacks something, states what can't be, or says otherwise than another one."""


@dataclass(frozen=True)
class Windows:
    """The limited windows in the order stated, and the grid of targets."""

    windows: tuple[int, ...]
    num_positions: int
    position_grid: str


@dataclass(frozen=True)
class Contract:
    """What a run's shards agree on. windows is None unless the run is of the window suite; shared holds all other keys."""

    top_k: int
    num_shards: int
    windows: Windows | None = None
    shared: dict = field(default_factory=dict)


def number(stated: dict, key: str, where: str, least: int = 0) -> int:
    value = stated.get(key)
    if value is None:
        raise ContractError(f"{where}: {key} is missing")
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ContractError(f"{where}: {key} can't be {value!r}")
    return value


def is_window_suite(stated: dict) -> bool:
    return WINDOW_SUITE in (stated.get("suite"), stated.get("condition"), stated.get("condition_prefix"))


def window_suite(stated: dict, where: str) -> Windows:
    windows = stated.get("windows")
    if not isinstance(windows, list):
        raise ContractError(f"{where}: windows must be a list")
    limited = [w for w in windows if w != "full"]
    if any(isinstance(w, bool) or not isinstance(w, int) or w < 0 for w in limited):
        raise ContractError(f"{where}: windows {windows!r} can't be")
    if len({str(w) for w in windows}) < len(windows):
        raise ContractError(f"{where}: windows repeat")
    if "full" not in windows or stated.get("full_condition") != "full":
        raise ContractError(f"{where}: the whole transcript must be a window, with the condition full")
    points, grid = number(stated, "num_positions", where, 1), stated.get("position_grid")
    if grid not in GRIDS or GRIDS[grid] not in (None, points):
        raise ContractError(f"{where}: position_grid {grid!r} with {points} positions can't be")
    if stated.get("condition_prefix", WINDOW_SUITE) != WINDOW_SUITE:
        raise ContractError(f"{where}: condition_prefix can't be {stated['condition_prefix']!r}")
    return Windows(tuple(limited), points, grid)


def contract_of(manifests: list[dict], launcher: dict | None, shards: int) -> Contract:
    """The contract of a run of `shards` shards; an error names the file and what is wrong with it.

    Manifests are one per shard, or none where the launcher's file stands for all. Each file must state top_k; all files
    agree on it and, if one is of the window suite, all are, with the same windows and grid. Other keys must be in all
    manifests alike.
    """
    named = [(f"manifest.{m.get('shard')}", m) for m in manifests]
    if not named and launcher is None:
        raise ContractError("no manifests")
    shared = run_contract(manifests) if manifests else {}
    if manifests and len(manifests) != shards:
        raise ContractError(f"manifests of {len(manifests)} shards, not {shards}")
    files = [*([("launcher", launcher)] if launcher is not None else []), *named]
    top_k = {where: number(m, "top_k", where) for where, m in files}
    if len(set(top_k.values())) > 1:
        raise ContractError(f"top_k differs: {top_k}")
    for where, m in files:
        if "num_shards" in m and number(m, "num_shards", where, 1) != shards:
            raise ContractError(f"{where}: manifests state {m['num_shards']} shards, not {shards}")
    suites = {where: window_suite(m, where) for where, m in files if is_window_suite(m)}
    if suites and len(suites) < len(files):
        raise ContractError(f"the window suite is missing from {sorted(set(w for w, _ in files) - set(suites))}")
    if len(set(suites.values())) > 1:
        raise ContractError(f"windows differ: {suites}")
    return Contract(next(iter(top_k.values())), shards, next(iter(suites.values()), None), shared)


#: Types of the columns that checks count with; tables of a run are text.
NUMBERS = {
    "choice_index": "int", "num_tokens": "int", "k_options": "int", "token_index": "int", "rank": "int", "token_id": "int", "n_tokens": "int", "window": "int", "target_index": "int", "effective_window": "int",
    "n_segments": "int", "target_fraction": "double", "logprob": "double", "nll": "double",
}
FLAGS = ("is_human", "is_anchor")


def typed(rows: DataFrame) -> DataFrame:
    """rows with the numbers and flags among their columns as such; empty text is null there."""
    empty = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    kinds = {c: NUMBERS.get(c, "boolean" if c in FLAGS else None) for c in rows.columns}
    return rows.select(*(F.col(c) if k is None else empty(c).cast(k).alias(c) for c, k in kinds.items()))
