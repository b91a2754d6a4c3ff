"""Names every query of the library with its SQL twin."""

from __future__ import annotations

from .plans import integrity, likelihood, protocol, readouts, reports, transcripts  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
