"""Gradient boosted trees with second-order gains, L1 and L2 terms, least gain, least child weight and columns per tree."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.session import ROWS_PER_TASK, VALUES_PER_TASK, keep, limit_of

# Trees whose values a row is given by looking them up, before the rows are written with their new prediction.
PENDING = 10
# Accuracy of the approximate quantiles that cut the features (one over the share of the ranks).
ACCURACY = 10_000
# Rows that one numpy pass handles, and of which a task is worth its start: smaller parts are put together.
PASS_ROWS = 1 << 16
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Settings. Names follow ``pyspark.ml`` where it has the parameter."""

    maxIter: int = 100
    maxDepth: int = 6
    stepSize: float = 0.1
    subsamplingRate: float = 0.8
    columnSampling: float = 0.8
    minChildWeight: float = 1.0
    minSplitGain: float = 0.0
    regAlpha: float = 0.0
    regLambda: float = 1.0
    maxBins: int = 64
    seed: int = 42

    def score(self, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Twice the loss that the best value takes off a node with these sums."""
        return self.shrunk(gradient) ** 2 / np.maximum(weight + self.regLambda, 1e-12)

    def shrunk(self, gradient: np.ndarray) -> np.ndarray:
        return np.sign(gradient) * np.maximum(np.abs(gradient) - self.regAlpha, 0.0)

    def value(self, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return -self.stepSize * self.shrunk(gradient) / np.maximum(weight + self.regLambda, 1e-12)


@dataclass
class Tree:
    """A binary heap of nodes: node i has children 2i + 1 and 2i + 2; ``feature`` -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray  # bins up to this one go left
    cut: np.ndarray  # values up to this one go left
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def _down(self, rows: int, levels: int, goes_left) -> np.ndarray:
        node, every = np.zeros(rows, dtype=np.int64), np.arange(rows)
        for _ in range(levels):
            f = self.feature[node]
            left = goes_left(every, f, node)
            node = np.where(f < 0, node, 2 * node + np.where(left, 1, 2))
        return node

    def nodes(self, bins: np.ndarray, missing: np.ndarray, levels: int) -> np.ndarray:
        """The node each row of binned features reaches after ``levels`` splits."""
        def left(every, f, node):
            b = bins[every, np.maximum(f, 0)]
            return np.where(b == missing[np.maximum(f, 0)], self.missing_left[node], b <= self.bin[node])

        return self._down(len(bins), levels, left)

    def values(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The value of each row of features; NaN is missing."""
        def left(every, f, node):
            v = x[every, np.maximum(f, 0)]
            return np.where(np.isnan(v), self.missing_left[node], v <= self.cut[node])

        return self.value[self._down(len(x), depth, left)]


def split_gains(settings: Boosting, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gains (nodes, features, 2, cuts) of every split, missing values right and left, and the left sums' gradient and weight.

    ``gradient`` and ``weight`` are (nodes, features, bins), the last bin being
    the missing values. A split that leaves a child too light has no gain.
    """
    g, w = gradient[..., :-1].cumsum(axis=-1)[..., :-1], weight[..., :-1].cumsum(axis=-1)[..., :-1]
    left = np.stack([np.stack([g, w]), np.stack([g + gradient[..., -1:], w + weight[..., -1:]])], axis=3)  # (2, nodes, features, side, cuts)
    total = np.stack([gradient.sum(axis=-1), weight.sum(axis=-1)])[:, :, :, None, None]
    right = total - left
    gain = 0.5 * (settings.score(*left) + settings.score(*right) - settings.score(*total))
    light = (left[1] < settings.minChildWeight) | (right[1] < settings.minChildWeight) | (left[1] <= 0) | (right[1] <= 0)
    return np.where(light, -np.inf, gain), left


def quantile_cuts(x: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """The cuts of each of the ``n`` features of an array column x: its quantiles below the greatest value, each once.

    One job, one row. Exact while a task may hold the values of a feature
    (``corelode.valuesPerTask``), beyond that within one in ACCURACY ranks.
    """
    shares = [i / bins for i in range(1, bins)]
    value = lambda i: F.nullif(F.col("x")[i], F.lit(float("nan")))
    exact = x.count() <= limit_of(x.sparkSession, "valuesPerTask", VALUES_PER_TASK)
    cut = lambda i: F.percentile(value(i), F.array(*map(F.lit, shares))) if exact else F.percentile_approx(value(i), shares, ACCURACY)
    row = x.agg(*[cut(i).alias(f"q{i}") for i in range(n)], *[F.max(value(i)).alias(f"m{i}") for i in range(n)]).first()
    return [np.array(sorted({q for q in row[f"q{i}"] or () if q < row[f"m{i}"]})) for i in range(n)]


@dataclass
class _Rows:
    """The binned rows (bins, label, held, hash, predicted) and the trees they have not been given yet.

    They are read in ``parts`` tasks at most; what one task reads is summed without a shuffle.
    """

    table: DataFrame
    missing: np.ndarray
    depth: int
    parts: int
    pending: list[Tree] = field(default_factory=list)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = len(self.missing)
        packed = batch.column("bins").cast(pa.binary(n))  # one width: the bytes lie one after the other
        bins = np.frombuffer(packed.buffers()[1] or b"", dtype=np.uint8)[packed.offset * n:(packed.offset + len(packed)) * n].reshape(-1, n)
        predicted = np.array(batch.column("predicted"), dtype=float)
        for tree in self.pending:
            predicted = predicted + tree.value[tree.nodes(bins, self.missing, self.depth)]
        return bins, np.asarray(batch.column("label")), np.asarray(batch.column("held")).astype(bool), np.asarray(batch.column("hash")), predicted

    def given(self) -> _Rows:
        """The rows written with the pending trees' values."""
        source = replace(self, table=None)  # a task needs no DataFrame

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *_, predicted = source.read(batch)
                yield batch.set_column(batch.schema.get_field_index("predicted"), "predicted", pa.array(predicted))

        return _Rows(keep(self.table.mapInArrow(run, self.table.schema)).coalesce(self.parts), self.missing, self.depth, self.parts)

    def after(self, tree: Tree) -> _Rows:
        self.pending.append(tree)
        return self.given() if len(self.pending) == PENDING else self

    def sums(self, *args) -> tuple[np.ndarray, np.ndarray, pd.Series]:
        return _sums(self, *args)


class _Held:
    """The same rows as arrays of one task, each with its prediction and its node of the tree that grows."""

    def __init__(self, rows: _Rows, batches: Iterator[pa.RecordBatch], width: int) -> None:
        bins, self.label, self.held, self.hashes, self.predicted = (np.concatenate(c) for c in zip(*map(rows.read, batches)))
        self.missing, self.bins, self.every = rows.missing, bins, np.arange(len(bins))
        self.slots = [np.where(bins[:, f] == m, width - 1, bins[:, f]).astype(np.uint16) for f, m in enumerate(rows.missing)]
        self.node = np.zeros(len(bins), np.int64)

    def _step(self, tree: Tree) -> None:
        f = tree.feature[self.node]
        split = f >= 0
        at = np.maximum(f, 0)
        b = self.bins[self.every, at]
        left = np.where(b == self.missing[at], tree.missing_left[self.node], b <= tree.bin[self.node])
        self.node = np.where(split, 2 * self.node + np.where(left, 1, 2), self.node)

    def after(self, tree: Tree) -> _Held:
        self._step(tree)  # from the last level that was summed to the leaves
        self.predicted = self.predicted + tree.value[self.node]
        return self

    def sums(self, settings: Boosting, tree: Tree, number: int, level: int, wanted: list[int], columns: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, pd.Series]:
        """As :func:`_sums`; levels come in order."""
        errors = None
        if level == 0:
            self.node[:] = 0
            residual = self.predicted - self.label
            parts = [~self.held, self.held]
            errors = pd.Series([*[np.square(residual[p]).sum() for p in parts], *[float(p.sum()) for p in parts]], index=[-1, -2, -3, -4])
            self.used = ~self.held & _sampled(self.hashes, number, settings)
            whole = np.rint(residual * scale).astype(np.int64)
            self.halves = [half.astype(float) for half in (whole >> 20, whole & 0xFFFFF)]
        else:
            self._step(tree)
        slot_of = np.full((2 << settings.maxDepth) - 1, -1)
        slot_of[wanted] = np.arange(len(wanted))
        slot = slot_of[self.node]
        used = np.flatnonzero((slot >= 0) & self.used)
        gradient, weight = _histograms(slot[used], [half[used] for half in self.halves], lambda f: self.slots[f][used], len(wanted), columns, settings.maxBins + 1)
        return gradient / scale, weight.astype(float), errors


def _sampled(hashes: np.ndarray, tree: int, settings: Boosting) -> np.ndarray:
    """Whether a tree sees a row: a hash of the row's own, the seed and the tree."""
    x = hashes.view(np.uint64) ^ np.uint64((settings.seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(33))) < np.uint64(min(int(settings.subsamplingRate * 2**64), 2**64 - 1))


def _histograms(slot: np.ndarray, halves: list[np.ndarray], bin_of: Callable[[int], np.ndarray], nodes: int, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and weight (node, column, bin) in whole numbers; a gradient comes in two halves, each summed exactly in doubles."""
    gradient, weight = np.zeros((2, nodes, len(columns), width), np.int64)
    base = slot * width
    for at, f in enumerate(columns):
        key = base + bin_of(f)
        count = lambda *values: np.bincount(key, *values, minlength=nodes * width).reshape(nodes, width).astype(np.int64)  # noqa: B023, E731
        weight[:, at] = count()
        gradient[:, at] = (count(halves[0]) << 20) + count(halves[1])
    return gradient, weight


def _sums(rows: _Rows, settings: Boosting, tree: Tree, number: int, level: int, wanted: list[int], columns: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Gradient and weight of every (wanted node, column, bin), and on the first level the squared errors.

    A task adds its rows into arrays and sends what is not zero; sums are whole
    numbers, so partitioning does not change them. At most nodes * columns *
    bins rows reach the driver.
    """
    width = settings.maxBins + 1
    slot_of = np.full((2 << settings.maxDepth) - 1, -1)
    slot_of[wanted] = np.arange(len(wanted))
    source = replace(rows, table=None)
    shape = (len(wanted), len(columns), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, weight = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        errors = np.zeros((2, 2))
        for whole in batches:
            for start in range(0, len(whole), PASS_ROWS):
                bins, label, held, hashes, predicted = source.read(whole.slice(start, PASS_ROWS))
                residual = predicted - label
                if level == 0:
                    errors[:, 0] += [np.square(residual[~held]).sum(), np.square(residual[held]).sum()]
                    errors[:, 1] += [(~held).sum(), held.sum()]
                slot = slot_of[tree.nodes(bins, source.missing, level)]
                used = np.flatnonzero((slot >= 0) & ~held & _sampled(hashes, number, settings))
                whole_gradient = np.rint(residual[used] * scale).astype(np.int64)
                slot_in = lambda f: np.where(bins[used, f] == source.missing[f], settings.maxBins, bins[used, f])  # noqa: B023, E731
                found = _histograms(slot[used], [whole_gradient >> 20, whole_gradient & 0xFFFFF], slot_in, len(wanted), columns, width)
                gradient, weight = gradient + found[0], weight + found[1]
        gradient, weight = gradient.ravel(), weight.ravel()
        at = np.flatnonzero(weight)
        columns_of = [at, gradient[at], weight[at].astype(float)]
        if level == 0:
            columns_of = [np.concatenate([columns_of[0], [-1, -2]]), np.concatenate([columns_of[1], [0, 0]]), np.concatenate([columns_of[2], errors[:, 0]])]
            columns_of = [np.concatenate([columns_of[0], [-3, -4]]), np.concatenate([columns_of[1], [0, 0]]), np.concatenate([columns_of[2], errors[:, 1]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_of], names=["slot", "gradient", "weight"])

    summed = rows.table.mapInArrow(run, "slot long, gradient long, weight double").groupBy("slot").agg(F.sum("gradient").alias("gradient"), F.sum("weight").alias("weight")).toArrow().to_pandas()
    counted = summed[summed["slot"] >= 0]
    gradient, weight = np.zeros(math.prod(shape)), np.zeros(math.prod(shape))
    gradient[counted["slot"]], weight[counted["slot"]] = counted["gradient"] / scale, counted["weight"]
    return gradient.reshape(shape), weight.reshape(shape), summed[summed["slot"] < 0].set_index("slot")["weight"]


def _grow(rows: _Rows | _Held, cuts: list[np.ndarray], settings: Boosting, number: int, scale: float) -> tuple[Tree, pd.Series]:
    """One tree: per level one aggregation, of the lighter child of each split; the other is the rest of its parent."""
    n = len(rows.missing)
    draw = np.random.default_rng([settings.seed, number])
    columns = np.sort(draw.choice(n, max(1, math.ceil(settings.columnSampling * n)), replace=False))
    tree = Tree.empty(settings.maxDepth)
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    parents: dict[int, int] = {0: -1}  # node to sum: its sibling's sums follow from the parent's
    errors = None
    for level in range(settings.maxDepth):
        wanted = sorted(parents)
        if not wanted:
            break
        gradient, weight, seen = rows.sums(settings, tree, number, level, wanted, columns, scale)
        errors = seen if level == 0 else errors
        now: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, node in enumerate(wanted):
            now[node] = gradient[at], weight[at]
            if parents[node] >= 0:
                above = sums[parents[node]]
                now[node + 1 if node % 2 else node - 1] = above[0] - gradient[at], above[1] - weight[at]
        if level == 0:
            tree.value[0] = settings.value(gradient[0, 0].sum(), weight[0, 0].sum())
        sums, parents = now, {}
        nodes = sorted(now)
        gain, left = split_gains(settings, np.stack([now[k][0] for k in nodes]), np.stack([now[k][1] for k in nodes]))
        for at, node in enumerate(nodes):
            best = int(gain[at].argmax())  # ties: the first feature, missing values right, the least cut
            f, side, cut = np.unravel_index(best, gain[at].shape)
            if gain[at, f, side, cut] - settings.minSplitGain <= LEAST_GAIN:
                continue
            g, w = left[:, at, f, side, cut]
            whole = now[node][0][f].sum(), now[node][1][f].sum()
            tree.feature[node], tree.bin[node], tree.cut[node] = columns[f], cut, cuts[columns[f]][cut]
            tree.missing_left[node], tree.gain[node] = side == 1, gain[at, f, side, cut]
            tree.value[2 * node + 1], tree.value[2 * node + 2] = settings.value(g, w), settings.value(whole[0] - g, whole[1] - w)
            parents[2 * node + (1 if 2 * w <= whole[1] else 2)] = node
    return tree, errors


@dataclass
class BoostedTrees:
    """A fitted model: the mean label and the trees."""

    settings: Boosting
    base: float
    trees: list[Tree]
    features: int
    history: list[tuple[int, float | None, float | None]]

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.values(x, self.settings.maxDepth)
        return out

    def importances(self) -> np.ndarray:
        """Total gain per feature, as shares of one."""
        total = np.zeros(self.features)
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(total, tree.feature[split], tree.gain[split])
        return total / (total.sum() or 1.0)

    def history_table(self, spark: SparkSession) -> DataFrame:
        """(iteration, train_rmse, validation_rmse): errors before the first tree and after each."""
        return spark.createDataFrame(self.history, "iteration int, train_rmse double, validation_rmse double")

    def to_json(self) -> str:
        trees = [[t.feature.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.value.tolist(), t.gain.tolist()] for t in self.trees]
        return json.dumps({"settings": asdict(self.settings), "base": self.base, "features": self.features, "history": self.history, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        trees = [Tree(np.array(f), np.zeros(len(f), np.int64), np.array(c), np.array(m, bool), np.array(v), np.array(g)) for f, c, m, v, g in d["trees"]]
        return cls(Boosting(**d["settings"]), d["base"], trees, d["features"], [tuple(h) for h in d["history"]])


def _prepared(df: DataFrame, settings: Boosting, features: str, label: str, held: str | None) -> tuple[_Rows, list[np.ndarray], float, float]:
    """The binned rows, the cuts, the mean label and the scale of whole-number gradients."""
    x = df.filter(F.col(label).isNotNull()).select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"), (F.col(held) if held else F.lit(False)).alias("held"))
    x = x.withColumn("hash", F.xxhash64("x", "label"))
    ends = x.filter("NOT held").agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.max(F.size("x")).alias("features")).first()
    if not ends["n"]:
        raise ValueError("no rows to train on")
    n, base = ends["features"], float(f"{ends['mean']:.10g}")  # digits that no order of summing changes
    reach, every = x.agg(F.max(F.abs(F.col("label") - base)), F.count("*")).first()
    reach = reach or 1.0
    cuts = quantile_cuts(x.filter("NOT held"), n, settings.maxBins)
    missing = np.array([len(c) + 1 for c in cuts])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("x").flatten(), dtype=float).reshape(-1, n)
            bins = np.empty(values.shape, dtype=np.uint8)
            for f, cut in enumerate(cuts):
                bins[:, f] = np.where(np.isnan(values[:, f]), missing[f], np.searchsorted(cut, values[:, f], side="left"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes() for b in bins]), batch.column("label"), batch.column("held"), batch.column("hash"), pa.array(np.full(len(bins), base))],
                names=["bins", "label", "held", "hash", "predicted"])

    parts = math.ceil(every / PASS_ROWS)  # hundreds of passes follow, each of which starts every part anew
    rows = _Rows(keep(x.coalesce(parts).mapInArrow(binned, "bins binary, label double, held boolean, hash long, predicted double")).coalesce(parts), missing, settings.maxDepth, parts)
    # Gradients as whole numbers: as fine as 62 bits allow for the sum of all.
    scale = 2.0 ** min(40, 60 - math.ceil(math.log2(ends["n"] + 1)) - math.ceil(math.log2(4 * reach)))
    return rows, cuts, base, scale


def root_gains(df: DataFrame, names: list[str], settings: Boosting = Boosting(), features: str = "features", label: str = "label") -> DataFrame:
    """(feature, cut, missing_left, gain) of every split of all rows, as the first node of a tree would see it."""
    rows, cuts, _, scale = _prepared(df, replace(settings, subsamplingRate=1.0), features, label, None)
    settings = replace(settings, subsamplingRate=1.0)
    gradient, weight, _ = _sums(rows, settings, Tree.empty(settings.maxDepth), 0, 0, [0], np.arange(len(cuts)), scale)
    gain, _ = split_gains(settings, gradient, weight)
    found = [
        (names[f], float(cut), bool(side), float(gain[0, f, side, at]))
        for f, cut_of in enumerate(cuts) for side in (0, 1) for at, cut in enumerate(cut_of) if np.isfinite(gain[0, f, side, at])]
    return df.sparkSession.createDataFrame(found, "feature string, cut double, missing_left boolean, gain double")


def _boosted(rows: _Rows | _Held, cuts: list[np.ndarray], settings: Boosting, base: float, scale: float) -> BoostedTrees:
    """The trees one after the other, with the errors before the first and after each."""
    trees, history = [], []

    def noted(errors: pd.Series) -> None:
        history.append((len(history), *[math.sqrt(errors[-1 - i] / errors[-3 - i]) if errors[-3 - i] else None for i in (0, 1)]))

    for number in range(settings.maxIter):
        tree, errors = _grow(rows, cuts, settings, number, scale)
        noted(errors)
        trees.append(tree)
        rows = rows.after(tree)
    noted(rows.sums(settings, Tree.empty(settings.maxDepth), settings.maxIter, 0, [0], np.zeros(1, np.int64), scale)[2])
    return BoostedTrees(settings, base, trees, len(cuts), history)


def fit(df: DataFrame, settings: Boosting = Boosting(), features: str = "features", label: str = "label", held: str | None = None) -> BoostedTrees:
    """Boosted trees on the vector column ``features``; rows where ``held`` is true only report their error.

    Features are cut at quantiles once, and the rows are written as one byte per
    feature. Every level of a tree is one pass over them: a task adds up
    gradients by (node, feature, bin), the sums meet in Spark, and the driver
    picks the splits. Every PENDING trees the rows are written with their
    prediction. Rows that one task may hold (``corelode.rowsPerTask``) stay in
    it for all passes, each of which would take a job of its own; the trees are
    the same. Rows with a null label do not count; NaN and null features are
    missing and go to the side that gains more.
    """
    rows, cuts, base, scale = _prepared(df, settings, features, label, held)
    if rows.parts * PASS_ROWS > limit_of(df.sparkSession, "rowsPerTask", ROWS_PER_TASK):
        return _boosted(rows, cuts, settings, base, scale)
    source = replace(rows, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _boosted(_Held(source, batches, settings.maxBins + 1), cuts, settings, base, scale).to_json()
        yield pa.RecordBatch.from_arrays([pa.array([text])], names=["fitted"])

    return BoostedTrees.from_json(rows.table.coalesce(1).mapInArrow(run, "fitted string").first()["fitted"])


class RegularisedBoosting(Estimator):
    """The estimator for ``pyspark.ml`` pipelines; keyword arguments are those of :class:`Boosting`."""

    def __init__(self, **settings) -> None:
        super().__init__()
        self.settings = Boosting(**settings)
        self.columns = {"features": "features", "label": "label", "prediction": "prediction"}

    def setFeaturesCol(self, name: str) -> RegularisedBoosting:  # noqa: N802 - names of pyspark.ml
        self.columns["features"] = name
        return self

    def setLabelCol(self, name: str) -> RegularisedBoosting:  # noqa: N802
        self.columns["label"] = name
        return self

    def setPredictionCol(self, name: str) -> RegularisedBoosting:  # noqa: N802
        self.columns["prediction"] = name
        return self

    def _fit(self, dataset: DataFrame) -> RegularisedModel:
        return RegularisedModel(fit(dataset, self.settings, self.columns["features"], self.columns["label"]), self.columns)


class _ModelWriter(MLWriter):
    def __init__(self, model: RegularisedModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(self.model.boosted.to_json(), json.dumps(self.model.columns))]
        self.sparkSession.createDataFrame(rows, "trees string, columns string").coalesce(1).write.parquet(f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> RegularisedModel:
        row = self.sparkSession.read.parquet(f"{path}/trees").first()
        return RegularisedModel(BoostedTrees.from_json(row["trees"]), json.loads(row["columns"]))


class RegularisedModel(Model, MLWritable, MLReadable):
    """Adds the prediction; Arrow batches, no shuffle. Pipelines save and load it."""

    def __init__(self, boosted: BoostedTrees, columns: dict[str, str]) -> None:
        super().__init__()
        self.boosted, self.columns = boosted, columns

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.boosted.importances())

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.boosted.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        boosted = self.boosted

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(boosted.values(np.stack([np.asarray(v, dtype=float) for v in x])) if len(x) else np.empty(0))

        return dataset.withColumn(self.columns["prediction"], predict(vector_to_array(self.columns["features"])))
