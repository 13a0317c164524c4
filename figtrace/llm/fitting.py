"""A small logistic regression, for calibrating scores on a bounded sample."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of the columns of ``x``, then the intercept, by Newton steps with damping."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * v @ v / 2)

    for _ in range(steps):
        p = probability(x @ w)
        curve = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * curve[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
