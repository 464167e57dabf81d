"""Extremely randomised trees: one random cut per node and feature, whole samples, all trees of a level together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.session import keep

# Sums (a node and a feature each) that one pass makes and the driver receives.
SLOTS = 1_000_000
PASS_ROWS = 1 << 14


@dataclass
class GrowingTree:
    """Nodes in the order they are made: a split node's children stand side by side; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def root(cls) -> GrowingTree:
        return cls(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1))

    def split(self, node: int, feature: int, cut: float, values: tuple[float, float]) -> int:
        """Makes the children of ``node`` and returns the first."""
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        self.feature, self.cut = np.append(self.feature, [-1, -1]), np.append(self.cut, [0.0, 0.0])
        self.left, self.value = np.append(self.left, [0, 0]), np.append(self.value, values)
        return first

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        node, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(levels):
            f = self.feature[node]
            if (f < 0).all():
                break
            right = x[every, np.maximum(f, 0)] > self.cut[node]  # NaN goes left
            node = np.where(f < 0, node, self.left[node] + right)
        return node


Sums = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _per_node(rows: DataFrame, trees: list[GrowingTree], nodes: list[tuple[int, int]], level: int, width: int, sums: Sums, merge: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for every (node, feature): ``sums`` makes them from a task's rows sorted by node, ``merge`` joins them."""
    wanted: dict[int, list[int]] = {}
    for at, (tree, _) in enumerate(nodes):
        wanted.setdefault(tree, []).append(at)
    (first_of, first_start, first_kind), (second_of, second_start, second_kind) = merge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.full((len(nodes), width), first_start), np.full((len(nodes), width), second_start)
        for batch in batches:
            for start in range(0, len(batch), PASS_ROWS):
                part = batch.slice(start, PASS_ROWS)
                x = np.array(part.column("x").flatten(), dtype=float).reshape(-1, width)
                y = np.asarray(part.column("y"))
                for tree, places in wanted.items():
                    slot_of = np.full(len(trees[tree].feature), -1)
                    slot_of[[nodes[p][1] for p in places]] = places
                    slot = slot_of[trees[tree].nodes(x, level)]
                    order = np.argsort(slot, kind="stable")[np.count_nonzero(slot < 0) :]
                    if not len(order):
                        continue
                    begin = np.flatnonzero(np.diff(slot[order], prepend=-1))
                    at = slot[order][begin]
                    a, b = sums(x[order], y[order], slot[order], begin)
                    first[at], second[at] = first_of(first[at], a), second_of(second[at], b)
        used = np.flatnonzero((first != first_start).ravel() | (second != second_start).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(first.ravel()[used]), pa.array(second.ravel()[used])], names=["slot", "a", "b"])

    name = {np.fmin: F.min, np.fmax: F.max, np.add: F.sum}
    found = rows.mapInArrow(run, f"slot long, a {first_kind}, b {second_kind}").groupBy("slot").agg(name[first_of]("a").alias("a"), name[second_of]("b").alias("b")).toPandas()
    out = np.full(len(nodes) * width, first_start), np.full(len(nodes) * width, second_start)
    out[0][found["slot"]], out[1][found["slot"]] = found["a"], found["b"]
    return out[0].reshape(-1, width), out[1].reshape(-1, width)


def _ranges(x: np.ndarray, y: np.ndarray, slot: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.fmin.reduceat(x, begin, axis=0), np.fmax.reduceat(x, begin, axis=0)


def _left_of(cuts: np.ndarray) -> Sums:
    def sums(x: np.ndarray, y: np.ndarray, slot: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = ~(x > cuts[slot])
        return np.add.reduceat(left, begin, axis=0, dtype=np.int64), np.add.reduceat(np.where(left, y[:, None], 0), begin, axis=0)

    return sums


def cuts_of(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A cut for each feature, even in the node's own range; the draw belongs to the tree and node."""
    return low + np.random.default_rng([seed, tree, node]).random(len(low)) * (high - low)


def fit(df: DataFrame, trees: int = 100, depth: int = 15, least_split: int = 5, least_leaf: int = 2, seed: int = 42, features: str = "features", label: str = "label") -> ForestOfCuts:
    """A forest on the vector column ``features``; rows with a null label do not count.

    Each level takes two passes for all trees: the ranges of the features in
    every node, which give the random cuts, and the sums left of the cuts. The
    cut with the least squared error splits the node. Sums of labels are whole
    numbers, so partitioning does not change the forest. Nodes are taken in
    runs of SLOTS sums, so neither a task nor the driver holds more.
    """
    known = df.filter(F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"))
    ends = known.agg(F.count("*").alias("n"), F.max(F.abs("label")).alias("reach"), F.max(F.size("x")).alias("width")).first()
    if not ends["n"]:
        raise ValueError("no rows to train on")
    scale = 2.0 ** min(40, 61 - math.ceil(math.log2(ends["n"] + 1)) - math.ceil(math.log2(2 * (ends["reach"] or 1.0))))
    rows = keep(known.select("x", F.round(F.col("label") * scale).cast("long").alias("y")))
    total = rows.agg(F.sum("y")).first()[0]
    width = ends["width"]
    grown = [GrowingTree.root() for _ in range(trees)]
    sizes = {(t, 0): (ends["n"], total) for t in range(trees)}
    for tree in grown:
        tree.value[0] = total / scale / ends["n"]
    gains = np.zeros(width)
    for level in range(depth):
        open_nodes = [k for k, (n, _) in sizes.items() if n >= max(least_split, 2 * least_leaf)]
        following: dict[tuple[int, int], tuple[int, int]] = {}
        step = max(1, SLOTS // width)
        for start in range(0, len(open_nodes), step):
            nodes = open_nodes[start : start + step]
            low, high = _per_node(rows, grown, nodes, level, width, _ranges, ((np.fmin, math.inf, "double"), (np.fmax, -math.inf, "double")))
            low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
            cuts = np.stack([cuts_of(seed, t, k, low[i], high[i]) for i, (t, k) in enumerate(nodes)])
            n_left, left = _per_node(rows, grown, nodes, level, width, _left_of(cuts), ((np.add, 0, "long"), (np.add, 0, "long")))
            whole = np.array([sizes[k] for k in nodes], dtype=float)[:, :, None]
            n, s = whole[:, 0], whole[:, 1] / scale
            n_right, s_left = n - n_left, left / scale
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s_left**2 / n_left + (s - s_left) ** 2 / n_right - s**2 / n
            gain = np.where((n_left >= least_leaf) & (n_right >= least_leaf) & (high > low), gain, -np.inf)
            for i, (t, k) in enumerate(nodes):
                f = int(gain[i].argmax())
                if not gain[i, f] > 1e-9:
                    continue
                a, b = int(n_left[i, f]), int(left[i, f])
                other = sizes[t, k][0] - a, sizes[t, k][1] - b
                first = grown[t].split(k, f, cuts[i, f], (b / scale / a, other[1] / scale / other[0]))
                following[t, first], following[t, first + 1] = (a, b), other
                gains[f] += gain[i, f]
        sizes = following
        if not sizes:
            break
    return ForestOfCuts(grown, depth, gains / (gains.sum() or 1.0))


@dataclass
class ForestOfCuts:
    trees: list[GrowingTree]
    depth: int
    importances: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        return sum(t.value[t.nodes(x, self.depth)] for t in self.trees) / len(self.trees)


class ExtraTrees(Estimator):
    """The estimator for ``pyspark.ml`` pipelines; keyword arguments are those of :func:`fit`."""

    def __init__(self, **settings) -> None:
        super().__init__()
        self.settings = settings
        self.columns = {"features": "features", "label": "label", "prediction": "prediction"}

    def setFeaturesCol(self, name: str) -> ExtraTrees:  # noqa: N802 - names of pyspark.ml
        self.columns["features"] = name
        return self

    def setLabelCol(self, name: str) -> ExtraTrees:  # noqa: N802
        self.columns["label"] = name
        return self

    def setPredictionCol(self, name: str) -> ExtraTrees:  # noqa: N802
        self.columns["prediction"] = name
        return self

    def _fit(self, dataset: DataFrame) -> ArrayModel:
        forest = fit(dataset, features=self.columns["features"], label=self.columns["label"], **self.settings)
        return ArrayModel(forest.values, self.columns, forest.importances)


class ArrayModel(Model):
    """Adds what a function of feature rows says; Arrow batches, no shuffle."""

    def __init__(self, values: Callable[[np.ndarray], np.ndarray], columns: dict[str, str], importances: np.ndarray) -> None:
        super().__init__()
        self.values, self.columns, self.importances = values, columns, importances

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = self.values

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(values(np.stack([np.asarray(v, dtype=float) for v in x])) if len(x) else np.empty(0))

        return dataset.withColumn(self.columns["prediction"], predict(vector_to_array(self.columns["features"])))
