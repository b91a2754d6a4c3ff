"""Bounded samples of labelled rows, and a small logistic regression on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows that a classifier is fitted on at most (about); more are sampled by a hash of their id.
TRAIN_ROWS = 100_000
#: Rows of a block of a Newton step.
BLOCK_ROWS = 4096


def labelled_rows(labels: DataFrame, column: str, keep_held_out: bool = False, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, label: about `most` rows at most, so a broadcast of them has a bound. The largest label of a doc_id counts.

    Rows with a null doc_id or label are left out, and those of the held-out fold unless keep_held_out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if not keep_held_out:
        known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def with_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs of the labelled rows with their label; rows is a bounded sample, hence the broadcast."""
    return docs.join(F.broadcast(rows), "doc_id")


class Logistic:
    """Logistic regression with an L2 penalty on standardized features, fitted by Newton steps."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """A step adds up blocks of rows, so the driver holds x and one block more."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        ridge = self.penalty * np.eye(x.shape[1] + 1)
        ridge[0, 0] = 1e-6
        w = np.zeros(x.shape[1] + 1)
        for _ in range(30):
            slope, bend = -ridge @ w, ridge.copy()
            for begin in range(0, len(x), BLOCK_ROWS):
                part = x[begin : begin + BLOCK_ROWS]
                z = np.column_stack([np.ones(len(part)), (part - self.mean) / self.scale])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                slope += z.T @ (y[begin : begin + BLOCK_ROWS] - p)
                bend += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
            step = np.linalg.solve(bend, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.w, -30, 30)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))
