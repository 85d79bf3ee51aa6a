"""Small models fitted here: a bounded sample of labelled rows and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id`` and ``y`` (long) of about ``most`` labelled documents, chosen by a hash of doc_id.

    Rows without id or label are left out; of several labels of one document the highest holds.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return own.groupBy("doc_id").agg(F.max(F.col(label).cast("long")).alias("y"))


def held_out(doc_id: Column) -> Column:
    """One document in five, whose label nothing here reads (null ids: held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept.

    Without rows, or with one class only, all slopes are zero.
    """
    wide = x.shape[1] + 1
    weights = np.zeros(wide)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    weights[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return weights
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(wide, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (p - y) + penalty * weights
        bend = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights
