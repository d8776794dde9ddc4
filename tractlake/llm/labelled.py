"""What the two classifiers share: the fold of a row, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One row in so many is held out.
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Whether CRC-32 of the key as text is divisible by FOLDS; a null key counts as empty text, and is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, constant first, of a ridge logistic regression by damped Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    keep[0] = 1e-6

    def loss(w):
        z = a @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (keep * w * w).sum()

    for _ in range(rounds):
        p = sigmoid(a @ w)
        gradient = a.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep), gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
