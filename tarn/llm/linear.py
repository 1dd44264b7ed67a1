"""Small linear models fitted in numpy on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Weights after ``steps`` of Adam from ``start``."""
    weights, mean, square = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, steps + 1):
        slope = gradient(weights)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        now = rate * (0.5 * (1 + np.cos(np.pi * step / steps)))
        weights -= now * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of ``doc_id``: the same in each run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
