"""Follow the regularised leader, proximal form, for logistic regression on sparse features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rates:
    """Learning rate alpha, its softening beta, and the L1 and L2 penalties."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0


class FTRL:
    """Weights exist only through the sums z and n of each coordinate; the last coordinate is the bias, free of penalties."""

    def __init__(self, size: int, rates: Rates) -> None:
        self.z, self.n, self.rates = np.zeros(size + 1), np.zeros(size + 1), rates

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z, n = self.rates, self.z[at], self.n[at]
        free = at == len(self.z) - 1
        l1, l2 = np.where(free, 0, r.l1), np.where(free, 0, r.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((r.beta + np.sqrt(n)) / r.alpha + l2))

    def step(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """``at``: distinct coordinates, ``weights`` what they weigh now."""
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.rates.alpha * weights
        self.n[at] = more

    def all_weights(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        return w[:-1], float(w[-1])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))
