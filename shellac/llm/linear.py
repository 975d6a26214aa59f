"""A small trainer for sparse logistic regression and for probability calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; L1 keeps weights of chance features at exactly 0."""

    def __init__(self, size: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def step(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient**2

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, importance: float = 1.0) -> None:
        """One example of log loss: distinct features ``at`` with values ``x``."""
        w = self.weights(at)
        self.step(at, importance * (sigmoid(w @ x) - y) * x, w)


def platt(scores: Sequence[float], labels: Sequence[int], rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps on smoothed labels; (1, 0) if a class is missing."""
    s, y = np.asarray(scores, float), np.asarray(labels, float)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([s, np.ones_like(s)], 1)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ v)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(h, x.T @ (p - t))
        v -= change * min(1.0, 5.0 / (1e-9 + np.abs(change).max()))
        if np.abs(change).max() < 1e-9:
            break
    return float(v[0]), float(v[1])
