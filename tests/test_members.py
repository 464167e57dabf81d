"""Extremely randomised trees against a plain loop; radial-basis regression against an exact kernel solution."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from corelode.operators import extra_trees as X
from corelode.operators import fourier as K


def table(spark, x, y):
    df = spark.createDataFrame([(list(map(float, a)), None if b is None else float(b)) for a, b in zip(x.tolist(), y)], "x array<double>, label double")
    return df.select(array_to_vector("x").alias("features"), "label")


def sample(n, seed):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.uniform(-2, 2, n), draw.integers(0, 4, n), draw.normal(size=n)])
    return x, np.sin(2 * x[:, 0]) * 3 + x[:, 1] + draw.normal(0, 0.05, n)


def plain_tree(x, y, seed, tree, depth, least_split, least_leaf):
    """Nodes in the order of their levels, as (feature, cut) or a value, by row lists."""
    out, level, made = {}, [(0, np.arange(len(y)))], 1
    for _ in range(depth + 1):
        following = []
        for node, rows in level:
            out[node] = y[rows].mean()
            if len(rows) < max(least_split, 2 * least_leaf) or _ == depth:
                continue
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            cuts, best = X.cuts_of(seed, tree, node, low, high), (1e-9, None)
            for f in range(x.shape[1]):
                left = x[rows, f] <= cuts[f]
                a, b = y[rows][left], y[rows][~left]
                if min(len(a), len(b)) < least_leaf or not high[f] > low[f]:
                    continue
                gain = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2 - len(rows) * y[rows].mean() ** 2
                if gain > best[0] * (1 + 1e-9):
                    best = gain, (f, cuts[f], left)
            if best[1]:
                f, cut, left = best[1]
                out[node] = (f, cut, made)
                following += [(made, rows[left]), (made + 1, rows[~left])]
                made += 2
        level = following
    return out


def test_forest_is_that_of_a_plain_loop(spark):
    x, y = sample(220, 1)
    forest = X.fit(table(spark, x, y).repartition(4), trees=2, depth=4, seed=7)
    for number, tree in enumerate(forest.trees):
        want = plain_tree(x, y, 7, number, 4, 5, 2)
        assert len(want) == len(tree.feature)
        for node, what in want.items():
            if isinstance(what, tuple):
                assert (tree.feature[node], tree.left[node]) == (what[0], what[2]) and tree.cut[node] == pytest.approx(what[1])
            else:
                assert tree.feature[node] == -1 and tree.value[node] == pytest.approx(what, abs=1e-6)


def test_forest_is_the_same_for_any_partitioning_and_run_length(spark, monkeypatch):
    x, y = sample(300, 2)
    one = X.fit(table(spark, x, y).repartition(1), trees=4, depth=8)
    monkeypatch.setattr(X, "SLOTS", 9)
    other = X.fit(table(spark, x, y).repartition(6), trees=4, depth=2)
    monkeypatch.undo()
    assert [t.value[:3].tolist() for t in one.trees] == [t.value[:3].tolist() for t in other.trees]
    assert len({t.cut[0] for t in one.trees}) == 4
    assert 1 - np.square(one.values(x) - y).sum() / np.square(y - y.mean()).sum() > 0.85
    assert one.importances.sum() == pytest.approx(1.0)


def test_odd_rows_of_forests(spark):
    x, y = sample(40, 3)
    x[:5, 2] = np.nan
    df = table(spark, x, [*y[:-1], None])
    model = X.ExtraTrees(trees=2, depth=2).fit(df)
    got = model.transform(df).collect()
    assert len(got) == 40 and all(np.isfinite(r.prediction) for r in got)
    with pytest.raises(ValueError):
        X.fit(df.limit(0))
    assert X.fit(table(spark, x, np.full(40, 2.0)), trees=1, depth=3).values(x).tolist() == [2.0] * 40


def exact_kernel(x, y, c, epsilon, gamma):
    """The same loss and penalty over the kernel itself, by plain Newton steps on 300 points."""
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = np.exp(-gamma * ((z[:, None] - z[None]) ** 2).sum(axis=2)) + 1e-8 * np.eye(len(y))
    root = np.linalg.cholesky(k)
    phi = np.hstack([root, np.ones((len(y), 1))])
    penalty, w = np.append(np.ones(len(y)), 1e-9), np.append(np.zeros(len(y)), y.mean())
    rounded = K.ROUNDED * y.std()

    def total(w):
        over = np.maximum(np.abs(phi @ w - y) - epsilon, 0)
        return 0.5 * (penalty * w * w).sum() + c * np.where(over < rounded, over**2 / (2 * rounded), over - rounded / 2).sum()

    for _ in range(200):
        slope, bend = K._loss_slopes(phi @ w - y, epsilon, rounded)
        step = np.linalg.solve(c * (phi * bend[:, None]).T @ phi + np.diag(penalty) + 1e-6 * np.eye(len(w)), c * phi.T @ slope + penalty * w)
        length = 1.0
        while length > 1e-6 and total(w - length * step) >= total(w):
            length /= 2
        w = w - length * step
    return phi @ w


def test_waves_come_close_to_the_exact_kernel(spark):
    x, y = sample(300, 4)
    waves, weights = K.fit_waves(table(spark, x, y).repartition(3), c=10.0, size=400)
    exact = exact_kernel(x, y, 10.0, 0.1, 1 / 3)
    got = waves.of(x) @ weights
    assert np.abs(got - exact).mean() < 0.1 * y.std()
    assert np.corrcoef(got, y)[0, 1] > 0.97


def test_radial_basis_estimator(spark):
    x, y = sample(80, 5)
    x[3, 1] = np.nan
    df = table(spark, x, [*y[:-1], None])
    rows = K.RadialBasisRegression(c=5.0, size=60).fit(df).transform(df).collect()
    assert len(rows) == 80 and all(np.isfinite(r.prediction) for r in rows)
    with pytest.raises(ValueError):
        K.fit_waves(df.limit(0))
