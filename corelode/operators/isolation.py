"""Isolation forest: trees grown on small hash samples, rows scored in batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.operators.prep import with_row
from corelode.operators.quantiles import quantiles

NODES = "tree long, node long, feature long, threshold double, left long, right long, path double"
WHOLE = 2**40


def _expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def tree_samples(df: DataFrame, columns: Sequence[str], ids: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """About ``size`` rows for each tree, chosen by a hash of the row's identity.

    A first draw keeps a few times as many rows as all trees need, so that only
    those are looked at once per tree.
    """
    known = df.dropna(subset=list(columns))
    total = max(known.count(), 1)
    share = min(1.0, 4 * trees * size / total)
    pool = known.filter(F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(WHOLE)) < int(share * WHOLE))
    chance = int(min(1.0, size / (total * share)) * WHOLE)
    drawn = F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")),
        lambda t: F.pmod(F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in ids], t), F.lit(WHOLE)) < chance)
    return pool.select(F.explode(drawn).alias("tree"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def grow(samples: DataFrame, width: int, size: int, seed: int) -> DataFrame:
    """Node table of the trees; one group holds one tree's sample."""
    deepest = math.ceil(math.log2(max(size, 2)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf[[f"x{i}" for i in range(width)]].sort_values([f"x{i}" for i in range(width)]).to_numpy()
        rng = np.random.default_rng([seed, tree])
        nodes, waiting = [], [(0, data, 0)]
        free = 1
        while waiting:
            node, part, depth = waiting.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth >= deepest or len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + _expected_path(len(part))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            below = part[:, f] < cut
            nodes.append((tree, node, f, cut, free, free + 1, 0.0))
            waiting += [(free, part[below], depth + 1), (free + 1, part[~below], depth + 1)]
            free += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return samples.groupBy("tree").applyInPandas(one, NODES)


def isolation_forest(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], contamination: float = 0.1, trees: int = 100, size: int = 256, seed: int = 42,
) -> DataFrame:
    """``anomaly_score`` (0..1) and ``is_outlier`` for the given share of rows.

    The node table has at most ``2 * trees * (a few times size)`` rows, whatever
    the data's size, and goes to every task.
    """
    nodes = grow(tree_samples(df, columns, ids, trees, size, seed), len(columns), size, seed).toPandas()
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
    norm = _expected_path(size) or 1.0

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, threshold, left, right, path in forest:
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                f = np.where(inner, feature[at], 0)
                down = np.where(x[row, f] < threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            total += path[at]
        return pd.Series(2 ** (-total / len(forest) / norm))

    known = df.dropna(subset=list(columns))
    if not forest:
        return known.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("is_outlier", F.lit(False))
    scored = known.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in columns]))
    limit = quantiles(scored, [], {"limit": (F.col("anomaly_score"), 1 - contamination)})
    return with_row(scored, limit).withColumn("is_outlier", F.col("anomaly_score") > F.col("_p.limit")).drop("_p")
