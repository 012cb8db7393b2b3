"""Hashed sparse features and follow-the-regularised-leader logistic regression, used by the text classifiers."""

from __future__ import annotations

import math

import numpy as np


class Ftrl:
    """Logistic regression by FTRL-Proximal over sparse rows (indices, values)."""

    def __init__(self, size: int, alpha=0.1, beta=1.0, l1=0.5, l2=1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, idx: np.ndarray, val: np.ndarray, y: float) -> None:
        w = self.weights(idx)
        g = (sigmoid(float(w @ val)) - y) * val
        n = self.n[idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] = n + g * g

    def fit(self, rows, labels, epochs: int, seed: int = 1):
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.step(*rows[i], labels[i])
        return self


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def sigmoids(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
