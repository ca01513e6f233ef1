"""The network against numeric slopes, planted series and a plain closed loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import networks as N


def test_slopes_equal_differences():
    g = np.random.default_rng(0)
    w, x = g.normal(size=4 * 5 + 1), g.uniform(-1, 1, (7, 3))
    f, j = N.response(w, x, 4)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert np.allclose((N.response(w + step, x, 4)[0] - N.response(w - step, x, 4)[0]) / 2e-6, j[:, i], atol=1e-7)
    assert f.shape == (7,)


def plain(net, rows):
    d = len(net.features)
    x = np.array([[(r[c] - lo) / (hi - lo) * 2 - 1 for c, (lo, hi) in ((c, net.ends[c]) for c in net.features)] for r in rows])
    lo, hi = net.ends[net.target]
    assert x.shape[1] == d
    return (N.response(net.weights, x, net.hidden)[0] + 1) / 2 * (hi - lo) + lo


def series(n=400):
    """y follows its last value and an input by a curve that no line has, for two keys, one of them null."""
    g, rows = np.random.default_rng(4), []
    for k in ("a", None):
        y = 0.3
        for t in range(n):
            x = float(g.uniform(-1, 1))
            rows.append((len(rows), k, t, x, y))
            y = float(0.8 * np.sin(2.5 * y) + 0.5 * x * x)
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(series(), "id long, k string, t long, x double, y double").repartition(3)
    net, out = N.autoregressive_network(df, ["k"], ["t"], "y", [1], "id", ["x"], [1], hidden=6, rounds=40)
    return df, net, out


def test_a_planted_series_is_learnt(spark, fitted):
    df, net, out = fitted
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 800 and sorted(i for i, r in rows.items() if r.y_hat is None) == [0, 400]
    error = np.array([r.y_hat - r.y for r in rows.values() if r.y_hat is not None])
    spread = np.std([r.y for r in rows.values()])
    assert np.sqrt((error**2).mean()) < 0.03 * spread
    fit = [e[0] for e in net.errors]
    assert fit == sorted(fit, reverse=True) and net.errors[-1][1] < 0.05 * spread


def test_columns_equal_the_plain_network_and_the_closed_loop(spark, fitted):
    df, net, out = fitted
    source = series()
    before = {(k, t): (y, x) for _, k, t, x, y in source}
    got = {(r.k, r.t): r.y_hat for r in out.collect()}
    for k, t in (("a", 5), (None, 399)):
        y, x = before[k, t - 1]
        assert abs(got[k, t] - plain(net, [{"y_1": y, "x_1": x}])[0]) < 1e-9
    known = spark.createDataFrame([("a", s, 0.1 * s) for s in range(1, 5)] + [(None, 1, 0.5), (None, 3, 0.5)], "k string, step int, x double")
    steps = {(r.k, r.step): r.y_hat for r in N.forecast(df, net, ["k"], ["t"], "y", [1], 5, ["x"], [1], known).collect()}
    y, x = before["a", 399]
    for s in range(1, 6):
        y = plain(net, [{"y_1": y, "x_1": x}])[0]
        assert abs(steps["a", s] - y) < 1e-9
        x = 0.1 * s
    assert steps[None, 2] is not None and steps[None, 3] is None and steps[None, 5] is None and len(steps) == 10


def test_a_loop_over_several_lags(spark):
    net = N.Network(["y_1", "y_3"], "y", {"y_1": (-1.0, 1.0), "y_3": (-1.0, 1.0), "y": (-1.0, 1.0)}, 1, np.array([0.7, -0.4, 0.1, 1.2, 0.05]), [])
    rows = [("a", t, v) for t, v in enumerate([0.1, -0.2, 0.3, 0.5])] + [("b", 0, 0.2)]
    got = N.forecast(spark.createDataFrame(rows, "k string, t int, y double"), net, ["k"], ["t"], "y", [1, 3], 4).orderBy("k", "step").collect()
    y = [0.1, -0.2, 0.3, 0.5]
    for _ in range(4):
        y.append(float(1.2 * np.tanh(0.7 * y[-1] - 0.4 * y[-3] + 0.1) + 0.05))
    assert np.allclose([r.y_hat for r in got if r.k == "a"], y[4:]) and [r.y_hat for r in got if r.k == "b"] == [None] * 4


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, 2.0 * (i % 7) if i % 11 else float("nan"), 1) for i in range(120)], "id long, a double, y double, _out int")
    net = N.network(df, ["a"], "y", "id", hidden=2, rounds=15)
    got = df.select("a", net.column().alias("p")).collect()
    assert all((r.p is None) == (r.a is None) for r in got) and max(abs(r.p - 2 * r.a) for r in got if r.a is not None) < 0.5
    flat = N.network(df.withColumns({"a": F.lit(1.0), "y": F.lit(3.0)}), ["a"], "y", "id", hidden=2, rounds=5)
    assert abs(df.select(flat.column({"a": F.lit(1.0)}).alias("p")).first().p - 3) < 1e-3
    assert df.limit(1).select(N.network(df.limit(0), ["a"], "y", "id").column().alias("p")).first().p is None
