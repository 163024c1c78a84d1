"""Logistic regression over sparse rows, by L-BFGS in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Rows:
    """Sparse rows: indices and values end to end, with each row's length. No row may be empty."""

    def __init__(self, indices: list[np.ndarray], values: list[np.ndarray] | None = None):
        lengths = np.array([len(x) for x in indices], np.int64)
        self.n = len(indices)
        self.index = np.concatenate(indices) if indices else np.zeros(0, np.int32)
        self.value = None if not values else np.concatenate(values).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if indices else np.zeros(0, np.int64)
        self.lengths = lengths

    def times(self, w: np.ndarray) -> np.ndarray:
        x = w[self.index]
        if self.value is not None:
            x = x * self.value
        return np.add.reduceat(x, self.starts).astype(np.float64)

    def gathered(self, g: np.ndarray, size: int) -> np.ndarray:
        x = np.repeat(g, self.lengths)
        if self.value is not None:
            x = x * self.value
        return np.bincount(self.index, weights=x, minlength=size)


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, scale: np.ndarray, l2: float, steps: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights (on scaled features) and intercept that minimise the weighted log loss plus l2/2 of the squared weights.

    target may lie between 0 and 1. With no rows, all weights are 0.
    """
    size = len(scale)
    if not rows.n:
        return np.zeros(size), 0.0
    weight = weight / weight.sum()

    def loss(p):
        z = rows.times((p[:-1] * scale).astype(np.float32)) + p[-1]
        value = float(np.sum(weight * (np.logaddexp(0, z) - target * z))) + 0.5 * l2 * float(p[:-1] @ p[:-1])
        g = weight * (sigmoid(z) - target)
        return value, np.append(rows.gathered(g, size) * scale + l2 * p[:-1], g.sum())

    p = np.zeros(size + 1)
    value, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1e-12, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        slope, step = -(grad @ q), 1.0
        for _ in range(20):
            new_value, new_grad = loss(p - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-14:
            past = [*past[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        p, value, grad = p + s, new_value, new_grad
        if done:
            break
    return p[:-1] * scale, float(p[-1])
