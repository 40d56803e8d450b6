"""Bounded labelled samples, and logistic weights for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, columns: list) -> DataFrame:
    """At most ``rows`` labelled rows of ``docs``, drawn by a hash of the id, never a held-out one.

    The drawn ids are at most ``rows``, so they are broadcast and the texts are not shuffled. An id labelled twice
    counts once, with its larger label; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    if n > rows:
        known = known.where(chance < int(1.1 * rows / n * (1 << 30))).orderBy(chance, "doc_id").limit(rows)
    return docs.join(F.broadcast(known), "doc_id").select("doc_id", "_label", *columns).orderBy("doc_id").limit(2 * rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights, intercept first, of a ridge logistic fit by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    if len(x) == 0:
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
