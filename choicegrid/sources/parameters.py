"""Parameters as they are written on a command line, and what a run's manifest says."""

from __future__ import annotations

import json
import platform
from importlib import metadata

from pyspark.sql import SparkSession

from .files import write_text

FULL = "full"


def parse_shard(text: str | None) -> tuple[int, int] | None:
    """`k/n` as (k, n) with 0 <= k < n; None for None."""
    if text is None:
        return None
    k, _, n = text.partition("/")
    if not (k.strip().isdigit() and n.strip().isdigit() and int(k) < int(n)):
        raise ValueError(f"{text!r} is no shard k/n")
    return int(k), int(n)


def parse_run(text: str) -> tuple[str, str]:
    """`label=path` as (label, path)."""
    label, sign, path = text.partition("=")
    if not (label and sign and path):
        raise ValueError(f"{text!r} is no label=path")
    return label, path


def parse_windows(text: str) -> list[int | str]:
    """Windows with commas between them: numbers from 0 on, or `full`, each once."""
    out: list[int | str] = []
    for item in (x.strip() for x in text.split(",")):
        if item != FULL and not (item.isascii() and item.isdigit()):
            raise ValueError(f"{item!r} is no window")
        window = item if item == FULL else int(item)
        if window in out:
            raise ValueError(f"window {item} repeats")
        out.append(window)
    return out


def library_versions(names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict[str, str]:
    """Versions of what a run computes with; a library that is missing is left out."""
    found = {"python": platform.python_version()}
    for name in names:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            continue
    return found


def write_manifest(spark: SparkSession, folder: str, parameters: dict, shard: int = 0) -> str:
    """`manifest.<shard>.json` in folder: the parameters, the shard and the libraries' versions. An existing one is an error."""
    name = f"{folder}/manifest.{shard}.json"
    write_text(spark, name, json.dumps({**parameters, "shard": shard, "versions": library_versions()}, sort_keys=True, indent=1))
    return name
