"""Radial-basis regression with an epsilon-insensitive loss, over random Fourier features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.operators.extra_trees import ArrayModel, ExtraTrees
from corelode.session import keep

# Random features that stand for the kernel.
SIZE = 200
# Widths over which the loss is rounded off, in deviations of the label, and Newton steps at each: a wide one is solved in a
# few steps and starts the next. The last is the loss that is minimised.
WIDTHS, STEPS = (1.0, 0.3, 0.1, 0.03, 0.01), 4
ROUNDED = WIDTHS[-1]
PASS_ROWS = 1 << 12


class Waves:
    """Features cos(w x + b) whose products have the Gaussian kernel exp(-gamma |x - x'|²) as their mean; the last is one."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, gamma: float, size: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.direction = draw.normal(0, np.sqrt(2 * gamma), (len(mean), size))
        self.shift = draw.uniform(0, 2 * np.pi, size)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((x - self.mean) / self.deviation)  # a missing value is an average one
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.direction + self.shift), np.ones((len(x), 1))])


def _loss_slopes(residual: np.ndarray, epsilon: float, rounded: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the epsilon-insensitive loss, rounded off to a parabola next to its edges."""
    over = np.abs(residual) - epsilon
    return np.sign(residual) * np.clip(over / rounded, 0, 1), ((over > 0) & (over < rounded)) / rounded


def _sums(rows: DataFrame, waves: Waves, weights: np.ndarray, epsilon: float, rounded: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, curvature and loss over all rows: one sum per task and cell, size² cells at most."""
    n = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, curvature, loss = np.zeros(n), np.zeros((n, n)), 0.0
        for batch in batches:
            for start in range(0, len(batch), PASS_ROWS):
                part = batch.slice(start, PASS_ROWS)
                z = waves.of(np.array(part.column("x").flatten(), dtype=float).reshape(len(part), -1))
                residual = z @ weights - np.asarray(part.column("y"))
                slope, bend = _loss_slopes(residual, epsilon, rounded)
                over = np.maximum(np.abs(residual) - epsilon, 0)
                loss += float(np.where(over < rounded, over * over / (2 * rounded), over - rounded / 2).sum())
                gradient += z.T @ slope
                curvature += (z * bend[:, None]).T @ z
        cells = np.concatenate([gradient, curvature.ravel(), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "v"])

    found = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    cells = np.zeros(n + n * n + 1)
    cells[found["cell"]] = found["v"]
    return cells[:n], cells[n:-1].reshape(n, n), float(cells[-1])


def fit_waves(df: DataFrame, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, size: int = SIZE, seed: int = 42, features: str = "features", label: str = "label"):
    """A function of feature rows: the weights that minimise |w|²/2 + c * sum of losses.

    Features are standardised; ``gamma`` defaults to one over their number. Rows
    become waves, so no kernel matrix exists; every damped Newton step is one
    pass, two where it is too long. Rows with a null label do not count.
    """
    rows = keep(df.filter(F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")))
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to train on")
    value = lambda i: F.nullif(F.col("x")[i], F.lit(float("nan")))
    ends = rows.agg(*[F.avg(value(i)) for i in range(width)], *[F.stddev_pop(value(i)) for i in range(width)], F.avg("y"), F.stddev_pop("y")).first()
    numbers = np.array([v or 0.0 for v in ends])
    waves = Waves(numbers[:width], numbers[width : 2 * width], gamma or 1 / width, size, seed)
    penalty = np.append(np.ones(size), 1e-9)  # the constant is free
    weights = np.append(np.zeros(size), numbers[-2])
    total = lambda w, loss: 0.5 * (penalty * w * w).sum() + c * loss
    for rounded in (width * max(numbers[-1], 1e-6) for width in WIDTHS):
        gradient, curvature, loss = _sums(rows, waves, weights, epsilon, rounded)
        for _ in range(STEPS):
            damped = c * curvature + np.diag(penalty) + np.eye(size + 1) * 1e-6
            step = np.linalg.solve(damped, c * gradient + penalty * weights)
            length, before = 1.0, total(weights, loss)
            while length > 1e-4:
                found = _sums(rows, waves, weights - length * step, epsilon, rounded)
                if total(weights - length * step, found[2]) < before:
                    break
                length /= 4
            else:
                break
            weights, (gradient, curvature, loss) = weights - length * step, found
            if before - total(weights, loss) < 1e-4 * before:
                break
    return waves, weights


class RadialBasisRegression(ExtraTrees):
    """The estimator for ``pyspark.ml`` pipelines; keyword arguments are those of :func:`fit_waves`."""

    def _fit(self, dataset: DataFrame) -> ArrayModel:
        waves, weights = fit_waves(dataset, features=self.columns["features"], label=self.columns["label"], **self.settings)
        return ArrayModel(lambda x: waves.of(x) @ weights, self.columns, np.zeros(len(waves.mean)))
