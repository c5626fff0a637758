"""From raw classifier scores to probabilities."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Slope and intercept of a weighted logistic regression on one score, by Newton's method."""
    columns = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(columns @ w)
        gradient = columns.T @ (weight * (p - y)) + ridge * np.array([w[0], 0.0])
        curve = (columns * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ columns + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w
