"""Adaptive splines against a plain search by least squares on whole design matrices, and planted products."""

import numpy as np
from pyspark.sql import functions as F

from heliograph.operators import splines as S

KNOTS = {"a": [-0.5, 0.0, 0.5], "b": [-0.4, 0.3], "c": [0.0]}


def rows(n=500, seed=2):
    g = np.random.default_rng(seed)
    x = g.uniform(-1, 1, (n, 3))
    y = 4 + 3 * np.maximum(0, x[:, 0] - 0.5) - 2 * np.maximum(0, -x[:, 0]) + 8 * np.maximum(0, x[:, 0]) * np.maximum(0, x[:, 1] - 0.3)
    return x, y + g.normal(0, 0.05, n)


def table(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(4)


def sse(b, y):
    return float(((y - b @ np.linalg.lstsq(b, y, rcond=None)[0]) ** 2).sum())


def plain(x, y, most, degree, penalty=3.0):
    """(terms after the forward rounds, those kept, gcv): every candidate is a least-squares fit of all rows."""
    terms, n = [()], len(y)
    while len(terms) < most:
        design = lambda ts: np.column_stack([S.unfolded(x, t) for t in ts])
        options = [(t, i, k) for t in terms if len(t) < degree for i, f in enumerate("abc") if all(i != h[0] for h in t) for k in KNOTS[f]]
        t, i, k = min(options, key=lambda o: sse(design([*terms, (*o[0], (*o[1:], 1)), (*o[0], (*o[1:], -1))]), y))
        for side in (1, -1):
            more = [*terms, (*t, (i, k, side))]
            if len(terms) < most and np.linalg.matrix_rank(design(more)) == len(more):
                terms = more
    use, models = list(terms), []
    while True:
        m = len(use)
        models.append((sse(design(use), y) / n / (1 - (m + penalty * (m - 1) / 2) / n) ** 2, use))
        if m == 1:
            break
        use = min(([*use[:j], *use[j + 1 :]] for j in range(1, m)), key=lambda u: sse(design(u), y))
    gcv, use = min(models, key=lambda v: v[0])
    return terms, use, gcv


def test_rounds_and_pruning_equal_a_plain_search(spark):
    x, y = rows()
    df = table(spark, x, y)
    terms, use, gcv = plain(x, y, 7, 2)
    grown = S.adaptive_splines(df, ["a", "b", "c"], "y", KNOTS, most=7, least_gain=0.0, prune=False)
    assert grown.terms == terms
    m = S.adaptive_splines(df, ["a", "b", "c"], "y", KNOTS, most=7, least_gain=0.0)
    design = np.column_stack([S.unfolded(x, t) for t in use])
    assert m.terms == use and abs(m.gcv - gcv) < 1e-8 * gcv
    assert np.allclose(m.coefficients, np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-6)
    assert abs(m.error - sse(design, y) / len(y)) < 1e-9
    got = df.select("a", "b", "c", m.column().alias("p")).collect()
    at = np.array([[r.a, r.b, r.c] for r in got])
    assert np.allclose([r.p for r in got], np.column_stack([S.unfolded(at, t) for t in use]) @ np.array(m.coefficients))


def test_a_planted_product_is_found_at_quantiles(spark):
    x, y = rows(1500, 3)
    m = S.adaptive_splines(table(spark, x, y), ["a", "b", "c"], "y", knots=15, most=15)
    assert m.error < 0.02 and any({h[0] for h in t} == {0, 1} for t in m.terms) and not any(h[0] == 2 for t in m.terms for h in t)


def test_nulls_far_scales_and_empty_tables(spark):
    df = spark.range(300).select(F.when(F.col("id") % 11 > 0, F.col("id") * 1e6).alias("a"), F.lit(1.0).alias("b"), F.when(F.col("id") % 9 > 0, F.greatest(F.lit(0.0), F.col("id") * 1e6 - 1e8) * 1e-9).alias("y"))
    m = S.adaptive_splines(df, ["a", "b"], "y", {"a": [5e7, 1e8, 2e8], "b": [1.0]}, most=9)
    got = df.select("a", "y", m.column().alias("p")).collect()
    assert all((r.p is None) == (r.a is None) for r in got) and max(abs(r.p - r.y) for r in got if r.y is not None and r.a is not None) < 1e-6
    flat = S.adaptive_splines(df.withColumn("y", F.lit(2.5)), ["a"], "y")
    assert flat.terms == [()] and flat.coefficients == [2.5]
    assert S.adaptive_splines(df.limit(0), ["a"], "y").terms == []
