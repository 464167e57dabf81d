"""Regularised boosting against a plain loop that tries every split."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corelode.operators import boosting as B


def table(spark, x, y, held=None):
    rows = [([None if v is None else float(v) for v in a], float(b), bool(h)) for a, b, h in zip(x.tolist(), y, held if held is not None else np.zeros(len(y)))]
    df = spark.createDataFrame(rows, "x array<double>, label double, held boolean")
    return df.select(array_to_vector("x").alias("features"), "label", "held")


def sample(n=200, seed=1):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 6, n), draw.normal(size=n), np.ones(n)])
    x[draw.random(n) < 0.15, 2] = np.nan
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + x[:, 1] + np.where(np.isnan(x[:, 2]), 3.0, 0.0) + draw.normal(0, 0.1, n)
    return x, y


class PlainTrees:
    """Every split of every node, a node at a time."""

    def __init__(self, x, y, cuts, s):
        self.s, self.cuts, self.base, self.trees = s, cuts, y.mean(), []
        p = np.full(len(y), self.base)
        for _ in range(s.maxIter):
            tree = {}
            self.grow(tree, x, p - y, np.arange(len(y)), 0, 0)
            self.trees.append(tree)
            p = p + self.of(tree, x)

    def score(self, g, w):
        return max(abs(g) - self.s.regAlpha, 0.0) ** 2 / (w + self.s.regLambda)

    def leaf(self, g, w):
        return -self.s.stepSize * math.copysign(max(abs(g) - self.s.regAlpha, 0.0), g) / (w + self.s.regLambda)

    def grow(self, tree, x, g, rows, node, depth):
        total, w = g[rows].sum(), len(rows)
        tree[node] = (None, self.leaf(total, w))
        best = (self.s.minSplitGain + B.LEAST_GAIN, None)
        if depth < self.s.maxDepth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for side in (False, True):
                    for cut in self.cuts[f]:
                        left = np.where(np.isnan(v), side, v <= cut)
                        n = left.sum()
                        if min(n, w - n) < max(self.s.minChildWeight, 1):
                            continue
                        gain = 0.5 * (self.score(g[rows][left].sum(), n) + self.score(g[rows][~left].sum(), w - n) - self.score(total, w))
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, cut, side, left))
        if best[1]:
            f, cut, side, left = best[1]
            tree[node] = ((f, cut, side), 0.0)
            self.grow(tree, x, g, rows[left], 2 * node + 1, depth + 1)
            self.grow(tree, x, g, rows[~left], 2 * node + 2, depth + 1)

    def of(self, tree, x):
        out = []
        for row in x:
            node = 0
            while tree[node][0]:
                f, cut, side = tree[node][0]
                node = 2 * node + (1 if (side if np.isnan(row[f]) else row[f] <= cut) else 2)
            out.append(tree[node][1])
        return np.array(out)

    def values(self, x):
        return self.base + sum(self.of(t, x) for t in self.trees)


WHOLE = dict(maxIter=2, maxDepth=3, subsamplingRate=1.0, columnSampling=1.0, maxBins=12)


@pytest.mark.parametrize("terms", [{}, dict(regAlpha=8.0, regLambda=5.0), dict(minSplitGain=20.0), dict(minChildWeight=30.0, regLambda=0.0)])
def test_trees_are_those_of_a_plain_loop(spark, terms):
    x, y = sample()
    df = table(spark, x, y).repartition(3)
    settings = B.Boosting(**(WHOLE | terms))
    got = B.fit(df, settings)
    cuts = B.quantile_cuts(df.select(F.expr("transform(array(0,1,2,3), i -> 0D)").alias("x")).limit(0), 4, 12)
    assert [len(c) for c in cuts] == [0, 0, 0, 0]
    cuts = [np.array(sorted({q for q in np.nanquantile(x[:, f], np.arange(1, 12) / 12) if q < np.nanmax(x[:, f])})) for f in range(4)]
    want = PlainTrees(x, y, cuts, settings)
    assert np.allclose(got.values(x), want.values(x), atol=1e-6)
    assert sum((t.feature >= 0).sum() for t in got.trees) == sum(v[0] is not None for t in want.trees for v in t.values()) > 0


def test_partitioning_changes_nothing_and_errors_fall(spark):
    x, y = sample(600, 2)
    held = np.arange(600) % 5 == 0
    settings = B.Boosting(maxIter=6, maxDepth=2, maxBins=20, stepSize=0.4)
    one = B.fit(table(spark, x, y, held).repartition(1), settings, held="held")
    other = B.fit(table(spark, x, y, held).repartition(7), settings, held="held")
    assert [t.value.tolist() for t in one.trees] == [t.value.tolist() for t in other.trees]
    assert [h[0] for h in one.history] == list(range(7))
    assert one.history[6][1] < 0.5 * one.history[0][1] and one.history[6][2] < 0.5 * one.history[0][2]
    rmse = math.sqrt(np.square(one.values(x[~held]) - y[~held]).mean())
    assert one.history[6][1] == pytest.approx(rmse)
    assert one.importances().sum() == pytest.approx(1.0) and one.importances()[3] == 0.0


def test_columns_and_rows_are_drawn_per_tree(spark):
    x, y = sample(300, 3)
    model = B.fit(table(spark, x, y), B.Boosting(maxIter=4, maxDepth=2, columnSampling=0.25, subsamplingRate=0.5, maxBins=16))
    used = [set(t.feature[t.feature >= 0].tolist()) for t in model.trees]
    assert all(len(u) <= 1 for u in used) and len(set(map(str, used))) > 1


def test_pipelines_save_and_load_the_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from corelode.operators.models import with_estimator

    x, y = sample(120, 6)
    df = spark.createDataFrame([(*map(float, r[:2]), float(v)) for r, v in zip(x.tolist(), y)], "a double, b double, label double")
    fitted = with_estimator(["a", "b"], B.RegularisedBoosting(maxIter=3, maxDepth=2)).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    pick = lambda m: sorted((r.label, r.prediction) for r in m.transform(df).collect())
    assert pick(again) == pick(fitted) and len({p for _, p in pick(fitted)}) > 2


def test_models_pass_through_json_and_pipelines(spark):
    x, y = sample(150, 4)
    df = table(spark, x, y)
    fitted = B.RegularisedBoosting(maxIter=3, maxDepth=2).fit(df)
    again = B.BoostedTrees.from_json(fitted.boosted.to_json())
    assert again.values(x).tolist() == fitted.boosted.values(x).tolist()
    assert json.loads(fitted.boosted.to_json())["settings"]["regLambda"] == 1.0
    scored = {round(r.label, 9): r.prediction for r in fitted.transform(df).collect()}
    assert [scored[round(v, 9)] for v in y.tolist()] == pytest.approx(fitted.boosted.values(x).tolist())
    assert fitted.featureImportances.toArray().sum() == pytest.approx(1.0) and fitted.getNumTrees == 3


def test_rows_without_label_and_no_rows(spark):
    x, y = sample(50, 5)
    df = table(spark, x, y)
    more = df.unionByName(df.limit(5).withColumn("label", F.lit(None).cast("double")))
    settings = B.Boosting(maxIter=2, maxDepth=2)
    assert B.fit(more, settings).values(x).tolist() == B.fit(df, settings).values(x).tolist()
    with pytest.raises(ValueError):
        B.fit(df.limit(0), settings)
    same = B.fit(table(spark, x, np.full(50, 2.5)), settings)
    assert same.values(x).tolist() == [2.5] * 50


def test_few_rows_are_summed_in_one_task_without_a_shuffle(spark):
    x, y = sample()
    df = table(spark, x, y).repartition(8)
    settings = B.Boosting(maxDepth=2)
    rows, cuts, _, scale = B._prepared(df, settings, "features", "label", None)
    tree, _ = B._grow(rows, cuts, settings, 0, scale)
    rows.pending.append(tree)
    after = rows.given()
    for r in (rows, after):
        assert r.table.rdd.getNumPartitions() == 1
        assert "Exchange" not in r.table.groupBy("hash").count()._jdf.queryExecution().executedPlan().toString()
    batch = rows.table.toArrow().combine_chunks().to_batches()[0]
    whole, part = rows.read(batch), rows.read(batch.slice(50, 30))
    assert (part[0] == whole[0][50:80]).all() and (part[-1] == whole[-1][50:80]).all() and rows.read(batch.slice(0, 0))[0].shape == (0, 4)
    again = after.table.toArrow()["predicted"].to_numpy()
    assert sorted(again) == sorted(whole[-1])


def test_rows_that_a_task_may_hold_stay_in_it_and_grow_the_same_trees(spark, monkeypatch):
    """600 passes, each a job of its own, took longer than their work."""
    x, y = sample(400, 7)
    held = np.arange(400) % 4 == 0
    df = table(spark, x, y, held).repartition(3)
    settings = B.Boosting(maxIter=12, maxDepth=4, maxBins=20, regAlpha=0.5)
    spark.conf.set("corelode.rowsPerTask", "100")
    try:
        passes = B.fit(df, settings, held="held")
    finally:
        spark.conf.unset("corelode.rowsPerTask")
    monkeypatch.setattr(B, "_sums", None)  # no pass is a job
    one = B.fit(df, settings, held="held")
    for field in ("feature", "cut", "missing_left", "value", "gain"):
        assert [getattr(t, field).tolist() for t in one.trees] == [getattr(t, field).tolist() for t in passes.trees]
    assert [h[0] for h in one.history] == list(range(13)) and all((t.feature >= 0).any() for t in one.trees)
    assert [h[1:] for h in one.history] == [pytest.approx(h[1:]) for h in passes.history]
