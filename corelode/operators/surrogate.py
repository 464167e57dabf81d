"""Proposals for a search over settings: expected improvement under a Gaussian process."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Settings drawn at random before the surrogate is asked, and those it is asked about.
FIRST, POOL = 5, 1000
NOISE = 1e-6


@dataclass(frozen=True)
class Range:
    """The values of one setting between two ends; ``log`` and ``power`` say how they are spread."""

    low: float
    high: float
    log: bool = False
    power: float = 1.0
    whole: bool = False

    def at(self, unit: float) -> float | int:
        value = self.low * (self.high / self.low) ** unit if self.log else self.low + (self.high - self.low) * unit**self.power
        return int(round(value)) if self.whole else float(value)


def _alike(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Matern covariance (5/2) of points of the unit cube."""
    r = math.sqrt(5) * np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(axis=2), 0)) / length
    return (1 + r + r * r / 3) * np.exp(-r)


def expected_improvement(tried: np.ndarray, errors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How much each point is expected to fall below the least error, under the likeliest of a few length scales."""
    mean, spread = errors.mean(), errors.std() or 1.0
    y = (errors - mean) / spread
    best = None
    for length in (0.2, 0.4, 0.8, 1.6, 3.2):
        root = np.linalg.cholesky(_alike(tried, tried, length) + NOISE * np.eye(len(tried)))
        half = np.linalg.solve(root, y)
        likelihood = -0.5 * half @ half - np.log(np.diag(root)).sum()
        if best is None or likelihood > best[0]:
            best = likelihood, length, root, half
    _, length, root, half = best
    across = np.linalg.solve(root, _alike(tried, points, length))
    guess, deviation = half @ across, np.sqrt(np.maximum(1 + NOISE - (across**2).sum(axis=0), 1e-12))
    z = (y.min() - guess) / deviation
    normal = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return (y.min() - guess) * normal + deviation * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def propose(tried: list[np.ndarray], errors: list[float], size: int, seed: int = 42) -> np.ndarray:
    """The next point of the unit cube: random for the first few, then the one of a random pool with the greatest expected improvement."""
    draw = np.random.default_rng([seed, len(tried)])
    if len(tried) < FIRST:
        return draw.random(size)
    done = np.array(tried)
    near = np.clip(done[int(np.argmin(errors))] + draw.normal(0, 0.1, (POOL // 4, size)), 0, 1)
    pool = np.vstack([draw.random((POOL, size)), near])
    return pool[int(np.argmax(expected_improvement(done, np.array(errors, dtype=float), pool)))]
