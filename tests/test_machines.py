"""Kernel machines against their optimality conditions and planted weights."""

import numpy as np

from heliograph.operators import frames, machines


def rows(n, seed=0):
    g = np.random.default_rng(seed)
    x = g.uniform(-1, 1, (n, 2))
    return x, 10 * np.sin(3 * x[:, 0]) + 5 * x[:, 1] + g.normal(0, 0.5, n)


def table(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")


def test_dual_equals_a_general_solver():
    """The same quadratic program, split into two nonnegative parts, by the barrier method."""
    x, y = rows(40)
    y = y - y.mean()
    k, c, e = machines.kernel(x, x, 2.0), 3.0, 0.5
    g = -y.copy()
    beta = machines.descend(k, g, np.zeros(40), e, c, 20_000, 1e-12)
    two = np.block([[k, -k], [-k, k]]) + 1e-10 * np.eye(80)
    a = np.concatenate([np.eye(80), -np.eye(80)])
    got, _, value = frames.barrier_minimum(two, np.concatenate([e - y, e + y]), a, np.concatenate([np.full(80, c), np.zeros(80)]), np.full(80, c / 2))
    own = 0.5 * beta @ k @ beta - y @ beta + e * np.abs(beta).sum()
    assert abs(own - value) < 1e-5 * (1 + abs(value)) and np.abs(g - (k @ beta - y)).max() < 1e-8
    primal, dual = machines.duality(k @ beta, y, beta, e, c)
    assert 0 <= primal - dual < 1e-6 * primal


def test_blocks_close_the_gap(spark):
    x, y = rows(160)
    df = table(spark, x, y)
    m = machines.epsilon_machine(df, ["a", "b"], "y", "id", c=20.0, epsilon=0.5, gamma=2.0, block=60, gap=1e-3)
    one = machines.epsilon_machine(df.repartition(5), ["a", "b"], "y", "id", c=20.0, epsilon=0.5, gamma=2.0, block=1000, gap=1e-3)
    assert -1e-9 <= m.gap <= 1e-3 and 1 < m.rounds < 200 and -1e-9 <= one.gap <= 1e-3 and (np.abs(m.beta) <= 20).all()
    grid = np.random.default_rng(1).uniform(-1, 1, (50, 2))
    assert np.abs(m.values(grid) - one.values(grid)).max() < 0.5
    out = m.predict(df.withColumnRenamed("y", "y0"), ["a", "b"]).collect()
    assert np.sqrt(np.mean([(r["y0"] - r["y_hat"]) ** 2 for r in out])) < 0.8
    missing = m.predict(spark.createDataFrame([(1, None, 0.5)], "id long, a double, b double"), ["a", "b"]).collect()
    assert missing[0]["y_hat"] is None or np.isnan(missing[0]["y_hat"])
    assert machines.epsilon_machine(df.limit(0), ["a", "b"], "y", "id").values(grid).tolist() == [0.0] * 50


def test_grid_equals_folds_one_by_one(spark):
    x, y = rows(60, 3)
    df = table(spark, x, y)
    got = {(r["epsilon"], r["gamma"], r["c"]): r["rmse"] for r in machines.machine_grid(df, ["a", "b"], "y", "id", [0.1, 2.0], [0.5, 4.0], [1.0, 10.0], folds=3).collect()}
    assert len(got) == 8
    data = machines.drawn(df, ["a", "b", "y"], "id", 1000)
    e, g, c = 0.1, 0.5, 10.0
    total = 0.0
    for f in range(3):
        own, rest = data[f::3], data[np.arange(60) % 3 != f]
        m = rest[:, 2].mean()
        beta = machines.descend(machines.kernel(rest[:, :2], rest[:, :2], g), -(rest[:, 2] - m), np.zeros(len(rest)), e, c, 300, 1e-4 * c)
        total += ((own[:, 2] - m - machines.kernel(own[:, :2], rest[:, :2], g) @ beta) ** 2).sum()
    assert abs(got[e, g, c] - np.sqrt(total / 60)) < 1e-9
    assert got[0.1, 0.5, 10.0] < got[2.0, 4.0, 1.0]


def test_planted_sparse_weights_are_found():
    g = np.random.default_rng(7)
    phi = g.normal(size=(120, 60))
    w = np.zeros(60)
    w[[4, 17, 33]] = [3.0, -2.0, 1.5]
    y = phi @ w + g.normal(0, 0.1, 120)
    got, used, _, noise = machines.evidence(phi, phi.T @ phi, y, 500, 1e-6)
    found = dict(zip(used.tolist(), got, strict=True))
    assert {4, 17, 33} <= set(found) and len(found) < 30  # a basis function of noise alone stays where its q^2 is over s, as one in three are
    assert all(abs(found[i] - w[i]) < 0.05 for i in (4, 17, 33)) and all(abs(v) < 0.06 for i, v in found.items() if not w[i])
    assert 0.005 < noise < 0.02


def test_relevance_machine_is_sparse_and_near(spark):
    x, y = rows(200, 5)
    m, noise = machines.relevance(table(spark, x, y), ["a", "b"], "y", "id", gamma=1.0)
    assert len(m.beta) < 40 and np.sqrt(np.mean((m.values(x) - y) ** 2)) < 0.7 and 0.1 < noise < 0.6
    empty, _ = machines.relevance(table(spark, x[:0], y[:0]), ["a", "b"], "y", "id")
    assert len(empty.beta) == 0


def test_components_equal_an_exact_decomposition(spark):
    from heliograph.operators import learning

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([r["embedding"] for r in e.select("embedding").collect()])
    value, vector = np.linalg.eigh(np.cov(x.T))
    mean, parts, size = learning.principal_components(e, "embedding", 3)
    assert np.allclose(mean, x.mean(0)) and np.allclose(size, value[::-1][:3], rtol=1e-6)
    assert all(abs(parts[i] @ vector[:, -1 - i]) > 1 - 1e-6 for i in range(3))
    odd = spark.createDataFrame([([1.0, 2.0],), (None,), ([float("nan"), 1.0],), ([3.0, 6.0],)], "v array<double>")
    mean, parts, size = learning.principal_components(odd, "v", 5)
    assert mean.tolist() == [2.0, 4.0] and abs(size[0] - 10) < 1e-9 and abs(size[1]) < 1e-9
    assert len(learning.principal_components(odd.limit(0), "v", 2)[2]) == 0
