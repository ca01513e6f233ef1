"""Model trees against a plain search and planted pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import trees


def table(spark, rows):
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], "a double, b double, y double")


def pieces(n=400, noise=0.0):
    g = np.random.default_rng(2)
    a, b = g.uniform(0, 1, n), g.uniform(0, 1, n)
    y = np.where(a <= 0.5, 2 + 3 * a, 10 - 4 * a + 2 * b) + noise * g.normal(size=n)
    return list(zip(a, b, y, strict=True))


def test_planted_pieces(spark):
    rows = pieces()
    tree = trees.model_tree(table(spark, [*rows, (None, 0.1, 1), (0.1, 0.2, None)]), ["a", "b"], "y", knots={"a": [0.25, 0.5, 0.75], "b": [0.5]}, depth=3, smoothing=0)
    assert (tree.feature, tree.value, tree.n) == ("a", 0.5, 400)
    d = table(spark, rows).withColumn("p", trees.tree_prediction(tree))
    assert d.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 1.0
    assert trees.model_tree(table(spark, []), ["a", "b"], "y") is None


def test_first_split_is_the_best_of_all(spark):
    rows = pieces(150, 0.5)
    d = np.array(rows)
    knots = {"a": [0.2, 0.4, 0.5, 0.7], "b": [0.3, 0.6]}
    tree = trees.model_tree(table(spark, rows), ["a", "b"], "y", knots=knots, depth=1, linear=False, prune=False, smoothing=0)
    best = max((d[:, 2].std() - sum((m.sum() / 150) * d[m, 2].std() for m in (d[:, i] <= k, d[:, i] > k)), -i, -k) for i, f in enumerate("ab") for k in knots[f])
    assert (tree.feature, tree.value) == ("ab"[-best[1]], -best[2])
    for side, m in ((tree.left, d[:, "ab".index(tree.feature)] <= tree.value), (tree.right, d[:, "ab".index(tree.feature)] > tree.value)):
        assert side.n == m.sum() and side.model["1"] == pytest.approx(d[m, 2].mean()) and side.sd == pytest.approx(d[m, 2].std())


def test_leaf_models_are_least_squares_and_useless_splits_go(spark):
    g = np.random.default_rng(4)
    a, b = g.uniform(0, 1, 300), g.uniform(0, 1, 300)
    rows = list(zip(a, b, 5 + 2 * a - 3 * b + 0.1 * g.normal(size=300), strict=True))
    full = trees.model_tree(table(spark, rows), ["a", "b"], "y", depth=3, prune=False, smoothing=0)
    cut = trees.model_tree(table(spark, rows), ["a", "b"], "y", depth=3, smoothing=0)
    assert len(full.leaves()) > 4 and cut.feature is None
    want = np.linalg.lstsq(np.column_stack([np.ones(300), a, b]), np.array(rows)[:, 2], rcond=None)[0]
    assert [cut.model[k] for k in ("1", "a", "b")] == pytest.approx(want.tolist())


def test_smoothing_mixes_upwards():
    root = trees.Node(n=100, feature="a", value=0.5, model={"1": 10.0, "a": 1.0})
    root.left, root.right = trees.Node(n=40, model={"1": 4.0}), trees.Node(n=60, model={"1": 6.0, "a": 2.0})
    trees._smooth(root, 15.0, [])
    assert root.left.model["1"] == pytest.approx((40 * 4 + 15 * 10) / 55) and root.left.model["a"] == pytest.approx(15 / 55)
    assert root.right.model["a"] == pytest.approx((60 * 2 + 15 * 1) / 75)
