"""Small models fitted on the driver from features that executors compute.

Training reads a bounded sample of labelled rows, chosen by the hash of the
identifier and so the same on each run, one document for each identifier. Their
features come to the driver: of fixed width for language ID; for mixing the
distinct words of a text and for quality all its passages, so there a long text
costs more, and the bound is on rows. Scoring reads every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hash_order(*columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(20240611), *columns), F.lit(_RANGE))


def sample_by_class(rows: DataFrame, label: str, bound: int, *key: str) -> DataFrame:
    """About bound rows, evenly over the classes as far as they have them. Nulls in label or key are left out."""
    named = rows.where(F.col(label).isNotNull() & F.col(key[0]).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(label).count().collect()}
    if not counts:
        return named
    each = bound / len(counts)
    cut = F.lit(0)
    for value, n in sorted(counts.items(), key=str):
        cut = F.when(F.col(label) == value, F.lit(int(_RANGE * min(1.0, each / n)))).otherwise(cut)
    return named.where(hash_order(*key) < cut)


def one_each(rows: DataFrame, *key: str) -> DataFrame:
    """One of the rows with equal keys, the one with the smallest hash of its text; rows are a bounded sample."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.xxhash64("text")).alias("r")).select(*key, "r.*")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic regression per column of y (0/1), by accelerated gradient descent on all rows."""
    n, width = x.shape
    weight = np.full((n, 1), 1 / max(1, n), np.float32) if weight is None else (weight / weight.sum()).astype(np.float32)[:, None]
    top = float(weight[:, 0] @ np.einsum("ij,ij->i", x, x)) + 1.0
    step = 4.0 / top
    w, b = np.zeros((width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb, was = w, b, 1.0
    for _ in range(rounds):
        z = x @ vw.astype(x.dtype) + vb  # the momentum is of float64, and so x would be copied
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
        nw, nb = vw - step * (x.T @ miss + decay * vw), vb - step * miss.sum(0)
        now = (1 + np.sqrt(1 + 4 * was * was)) / 2
        vw, vb = nw + (was - 1) / now * (nw - w), nb + (was - 1) / now * (nb - b)
        w, b, was = nw, nb, now
    return w, b


def fit_softmax(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, width: int, y: np.ndarray, classes: int, rounds: int = 150, decay: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on sparse rows with classes weighted evenly; accelerated gradient descent."""
    share = np.bincount(y, minlength=classes).astype(np.float64)
    weight = (1.0 / np.maximum(share, 1))[y]
    weight /= weight.sum()
    target = np.zeros((n, classes))
    target[np.arange(n), y] = 1
    step = 2.0 / ((weight * np.bincount(rows, vals * vals, n)).sum() + 1.0)
    w, b = np.zeros((width, classes)), np.zeros(classes)
    vw, vb, was = w, b, 1.0
    for _ in range(rounds):
        z = np.stack([np.bincount(rows, vals * vw[cols, k], n) for k in range(classes)], 1) + vb
        z = np.exp(z - z.max(1, keepdims=True))
        miss = weight[:, None] * (z / z.sum(1, keepdims=True) - target)
        grad = np.stack([np.bincount(cols, vals * miss[rows, k], width) for k in range(classes)], 1)
        nw, nb = vw - step * (grad + decay * vw), vb - step * miss.sum(0)
        now = (1 + np.sqrt(1 + 4 * was * was)) / 2
        vw, vb = nw + (was - 1) / now * (nw - w), nb + (was - 1) / now * (nb - b)
        w, b, was = nw, nb, now
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
