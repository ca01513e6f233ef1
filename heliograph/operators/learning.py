"""Regression and evaluation on Spark: normal equations by aggregation, neighbours, stratified splits, recalibration."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.logs import kept
from .relations import nearest_neighbours


def with_powers(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the square and the root of every feature."""
    return df.withColumns({f"{c}_{n}": f for c in features for n, f in (("sq", F.col(c) * F.col(c)), ("root", F.sqrt(F.col(c))))})


def terms(features: list[str], interactions: bool = True) -> dict[str, Column]:
    """Intercept, features and, if asked, their pairwise products."""
    out = {"1": F.lit(1.0)} | {c: F.col(c).cast("double") for c in features}
    return out | {f"{a}:{b}": F.col(a).cast("double") * F.col(b) for a, b in combinations(features, 2) if interactions}


def normal_equations(df: DataFrame, features: list[str], target: str, interactions: bool = True, weight: Column | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, X'X, X'y), by one aggregation over the rows."""
    x, w = terms(features, interactions), F.lit(1.0) if weight is None else weight
    names, y = list(x), F.col(target).cast("double")
    cells = {f"{i}_{j}": F.sum(w * x[names[i]] * x[names[j]]) for i in range(len(names)) for j in range(i, len(names))}
    cells |= {f"y_{i}": F.sum(w * x[n] * y) for i, n in enumerate(names)}
    ok = F.col(target).isNotNull()
    for c in features:
        ok = ok & F.col(c).isNotNull()
    got = df.where(ok).agg(*[c.alias(k) for k, c in cells.items()]).first()
    a = np.array([[got[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    return names, a, np.array([got[f"y_{i}"] or 0.0 for i in range(len(names))])


def least_squares(df: DataFrame, features: list[str], target: str, interactions: bool = True, ridge: float = 0.0, weight: Column | None = None) -> dict[str, float]:
    """Coefficients by term, 0 where there are no rows; the driver solves terms x terms numbers."""
    names, a, b = normal_equations(df, features, target, interactions, weight)
    beta = np.linalg.lstsq(a + ridge * np.eye(len(names)), b, rcond=None)[0]
    return dict(zip(names, map(float, beta), strict=True))


def bounded_least_squares(df: DataFrame, features: list[str], target: str, low: dict[str, float], high: dict[str, float], weight: Column | None = None, rounds: int = 5000, ridge: float = 1e-9) -> dict[str, float]:
    """Coefficients by term of the least weighted squared error within bounds of some terms ("1": the intercept), by
    coordinate descent over terms x terms numbers on the driver."""
    names, a, b = normal_equations(df, features, target, False, weight)
    a = a + ridge * np.eye(len(names))
    ends = [(low.get(n, -np.inf), high.get(n, np.inf)) for n in names]
    beta = np.clip(np.linalg.solve(a, b), *np.array(ends).T)
    for _ in range(rounds):
        before = beta.copy()
        for i, (lo, hi) in enumerate(ends):
            beta[i] = min(max(beta[i] + (b[i] - a[i] @ beta) / a[i, i], lo), hi)
        if np.abs(beta - before).max() <= 1e-13 * (1 + np.abs(beta).max()):
            break
    return dict(zip(names, map(float, beta), strict=True))


def linear_prediction(coefficients: dict[str, float], features: list[str], least: float | None = 0.0) -> Column:
    x = terms(features, any(":" in k for k in coefficients))
    out = F.lit(0.0)
    for k, b in coefficients.items():
        out = out + b * x[k]
    return out if least is None else F.greatest(out, F.lit(least))


def robust_least_squares(df: DataFrame, features: list[str], target: str, rounds: int = 10) -> dict[str, float]:
    """Bisquare regression: each round is one aggregation for the scale and one for the weighted normal equations."""
    beta = least_squares(df, features, target, interactions=False)
    for _ in range(rounds):
        r = F.col(target) - linear_prediction(beta, features, None)
        scale = df.agg(F.percentile_approx(F.abs(r), 0.5, 10000).alias("m")).first()["m"]
        if not scale:
            break
        u = r / (4.685 * scale / 0.6745)
        beta = least_squares(df, features, target, interactions=False, weight=F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0))
    return beta


def neighbour_regression(queries: DataFrame, train: DataFrame, qid: str, pid: str, features: list[str], target: str, k: int = 10, inverse: bool = False) -> DataFrame:
    """qid, y: mean of the k nearest targets (L1), weighted by distance share, or by inverse distance if asked.

    Distance-share weights grow with distance: that is the published behaviour; ties at distance 0 alone weigh equally.
    """
    near = nearest_neighbours(queries, train, qid, pid, features, k).join(train.select(pid, F.col(target).cast("double").alias("_y")), pid)
    w = 1 / (F.col("distance") + 1e-9) if inverse else F.col("distance")
    total = F.sum(w)
    return near.groupBy(qid).agg(F.when(total > 0, F.sum(w * F.col("_y")) / total).otherwise(F.avg("_y")).alias("y"))


def local_linear(queries: DataFrame, train: DataFrame, qid: str, pid: str, feature: str, target: str, k: int = 20) -> DataFrame:
    """qid, y: a line through the k nearest points, weighted by a tricube of distance; flat where they share one place."""
    t = train.select(pid, F.col(feature).cast("double").alias("_x"), F.col(target).cast("double").alias("_y"))
    near = nearest_neighbours(queries, train, qid, pid, [feature], k).join(t, pid).join(queries.select(qid, F.col(feature).cast("double").alias("_q")), qid)
    far = F.max("distance").over(W.partitionBy(qid))
    near = near.withColumn("_f", far)
    u = F.when(F.col("_f") > 0, F.col("distance") / (F.col("_f") * 1.0001)).otherwise(0.0)
    near = near.withColumn("_w", F.pow(1 - u * u * u, F.lit(3))).withColumn("_dx", F.col("_x") - F.col("_q"))
    s = near.groupBy(qid).agg(*[F.sum(F.col("_w") * e).alias(n) for n, e in (("s0", F.lit(1.0)), ("s1", F.col("_dx")), ("s2", F.col("_dx") * F.col("_dx")), ("t0", F.col("_y")), ("t1", F.col("_dx") * F.col("_y")))])
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return s.select(qid, F.when(det > 1e-9, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0")).alias("y"))


# Bins of the target, the part of n that each may give, and whether at most 70 % of the bin.
STRATA = ((None, 100, 5, False), (100, 200, 5, False), (200, 300, 5, True), (300, 400, 5, True), (400, 600, 10, True))


def stratified_train(df: DataFrame, key: str, target: str, n: int, seed: int = 1) -> DataFrame:
    """df with is_train: of each bin of the target a quota of rows in the order of md5(seed|key); the rest, and all from
    600 on, is for testing. Rows are ranked within (bin, first hex digits of the hash), so no bin is sorted whole."""
    t, h = F.col(target), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    b = F.lit(None).cast("int")
    for i, (lo, hi, _, _) in reversed(list(enumerate(STRATA))):
        b = F.when((t < hi) if lo is None else (t >= lo) & (t < hi), i).otherwise(b)
    d = df.withColumn("_b", b).withColumn("_h", h).withColumn("_c", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = d.groupBy("_b", "_c").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("_b")
    sizes = sizes.select(F.col("_b").alias("_sb"), F.col("_c").alias("_sc"), F.coalesce(F.sum("_n").over(w.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_t"))
    quota = F.lit(0)
    for i, (_, _, part, capped) in enumerate(STRATA):
        q = F.lit(n // part)
        quota = F.when(F.col("_b") == i, F.least(q, F.floor(0.7 * F.col("_t"))) if capped else q).otherwise(quota)
    d = d.withColumn("_r", F.row_number().over(W.partitionBy("_b", "_c").orderBy("_h", key))).join(sizes, F.col("_b").eqNullSafe(F.col("_sb")) & (F.col("_c") == F.col("_sc")))
    return d.select(*df.columns, F.coalesce(F.col("_r") + F.col("_before") <= quota, F.lit(False)).alias("is_train"))


def recalibration(df: DataFrame, x: str, y: str, bins: int = 20, low: float = 300.0) -> DataFrame:
    """bin, slope, intercept, n: a line of y on x per bin of x from its least to its largest value; bins below low and
    those of a negative or undefined slope take the line of all rows."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    line = [F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n")]
    whole = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.regr_slope("y", "x").alias("gs"), F.regr_intercept("y", "x").alias("gi"))
    d = d.crossJoin(F.broadcast(whole))  # one row
    b = F.least(F.lit(bins), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1).cast("long")
    g = d.groupBy(b.alias("bin"), "lo", "hi", "gs", "gi").agg(*line)
    use = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins > low) & (F.col("slope") > 0)
    return g.select("bin", F.when(use, F.col("slope")).otherwise(F.col("gs")).alias("slope"), F.when(use, F.col("intercept")).otherwise(F.col("gi")).alias("intercept"), "n")


def forward_selection(df: DataFrame, features: list[str], target: str, least_gain: float = 0.708) -> list[str]:
    """Features in the order in which each lowers the squared error most, until the gain in its deviance is under least_gain.

    All candidates of a round come from one cached matrix of sums: a single pass over the rows serves the whole search.
    """
    x = terms(features, False)
    names, y = [*x, "y"], F.col(target).cast("double")
    cols = [*x.values(), y]
    got = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    a = np.array([[got[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    n, last = a[0, 0], len(cols) - 1

    def sse(use: list[int]) -> float:
        b = np.linalg.lstsq(a[np.ix_(use, use)], a[use, last], rcond=None)[0]
        return max(float(a[last, last] - b @ a[use, last]), 1e-12)

    taken = [0]
    while left := [i for i in range(1, last) if i not in taken]:
        best = min(left, key=lambda i: (sse([*taken, i]), i))
        if n * (np.log(sse(taken)) - np.log(sse([*taken, best]))) < least_gain:
            break
        taken.append(best)
    return [names[i] for i in taken[1:]]


def kernel_regression(df: DataFrame, features: list[str], target: str, gamma: float = 8.0, width: int = 256, ridge: float = 1e-3, seed: int = 5):
    """An RBF regression by random Fourier features: a fitted function of df that adds y_hat.

    Stands in for a kernel machine: width cosines of the features approximate the kernel, the fit is one summing pass over
    Arrow batches (width x width sums per task), so that training scales with the rows.
    """
    import pandas as pd

    rng = np.random.default_rng(seed)
    wave, phase = rng.normal(0, (2 * gamma) ** 0.5, (len(features), width)), rng.uniform(0, 2 * np.pi, width)
    lift = lambda p: np.concatenate([np.ones((len(p), 1)), (2 / width) ** 0.5 * np.cos(p[features].to_numpy(float) @ wave + phase)], 1)

    def sums(batches):
        total = np.zeros((width + 1, width + 2))
        for p in batches:
            p = p.dropna()
            z = lift(p)
            total += z.T @ np.column_stack([z, p[target].to_numpy(float)])
        yield pd.DataFrame({"row": np.arange(width + 1), "cells": list(total)})

    rows = df.select(*features, target).mapInPandas(sums, "row int, cells array<double>")
    parts = rows.select("row", F.posexplode("cells").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("c"))
    m = np.array([[x["v"] for x in r["c"]] for r in parts.orderBy("row").collect()])  # width + 1 rows
    beta = np.linalg.solve(m[:, :-1] + ridge * np.eye(width + 1), m[:, -1])

    def predict(other: DataFrame) -> DataFrame:
        import pyspark.sql.types as T

        def run(batches):
            for p in batches:
                yield p.assign(y_hat=lift(p) @ beta)

        return other.mapInPandas(run, T.StructType([*other.schema.fields, T.StructField("y_hat", T.DoubleType())]))

    return predict


def least_absolute(x: np.ndarray, y: np.ndarray, few: int = 64) -> tuple[float, float, float]:
    """(error, intercept, slope) of the line of least total absolute error; of equal ones the flattest, then the lowest.

    For a slope the best intercept is the median of what it leaves, and the error is convex in the slope: a section search
    over it ends at the samples the best line passes through, of which there are few. A few samples are tried in all pairs.
    """
    def best(slopes, xs, ys):
        c = np.concatenate([ys - slopes * xs])
        e = np.array([np.abs(y - d - m * x).sum() for m, d in zip(slopes, c, strict=True)])
        i = np.lexsort((c, np.abs(slopes), np.round(e, 9)))[0]
        return float(np.round(e[i], 9)), float(c[i]), float(slopes[i])

    if len(x) > few and np.ptp(x) > 0:
        gap = np.diff(np.unique(x)).min()
        lo, hi = -np.ptp(y) / gap, np.ptp(y) / gap
        error = lambda m: np.abs((r := y - m * x) - np.median(r)).sum()
        g = (5**0.5 - 1) / 2
        u, v = hi - g * (hi - lo), lo + g * (hi - lo)
        eu, ev = error(u), error(v)
        while hi - lo > 1e-13 * max(1.0, abs(lo), abs(hi)) and u < v:
            if eu <= ev:
                hi, v, ev = v, u, eu
                u = hi - g * (hi - lo)
                eu = error(u)
            else:
                lo, u, eu = u, v, ev
                v = lo + g * (hi - lo)
                ev = error(v)
        m = (lo + hi) / 2
        r = y - m * x
        near = np.argsort(np.abs(r - np.median(r)), kind="stable")[:few]
        xs, ys = x[near], y[near]
    else:
        xs, ys = x, y
    i, j = np.nonzero(xs[None] > xs[:, None])
    slopes = np.concatenate([np.zeros(len(xs)), (ys[j] - ys[i]) / (xs[j] - xs[i])])
    return best(slopes, np.concatenate([xs, xs[i]]), np.concatenate([ys, ys[i]]))


def absolute_line(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """key, slope, intercept, error: the line of least total absolute error of each group; of equal ones the flattest, then
    the lowest. Such a line passes through two samples, or is flat through one where x never varies. A group, a pixel's
    samples, is one task's; many groups are a batch, and the work grows with a group's samples, not their pairs."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("p"))
    g = p.groupBy(*key).agg(F.collect_list("p").alias("g")).select(*key, F.col("g.x").alias("_x"), F.col("g.y").alias("_y"))

    def run(parts):
        for b in parts:
            got = [least_absolute(u, v) for u, v in zip(b["_x"], b["_y"], strict=True)]
            yield pd.concat([b[key].reset_index(drop=True), pd.DataFrame(got, columns=["error", "intercept", "slope"])[["slope", "intercept", "error"]]], axis=1)

    return g.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", slope double, intercept double, error double")


def grid_search(df: DataFrame, features: list[str], target: str, id_col: str, penalties: list[float], folds: int = 5) -> list[tuple[float, float]]:
    """(penalty, rmse) of ridge regression by cross-validation, best first; a row's fold is its id's crc32.

    One pass: each fold's sums of products suffice for every penalty and every training set.
    """
    cols = [F.col(c).cast("double") for c in features] + [F.lit(1.0), F.col(target).cast("double")]
    n = len(cols)
    ok = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in [*features, target])))
    sums = ok.groupBy((F.crc32(F.col(id_col).cast("string").cast("binary")) % folds).alias("_f")).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).collect()  # a row a fold
    g = [np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float) for r in sums]
    total, out = sum(g), []
    for c in penalties:
        error = count = 0.0
        for own in g:
            a = (total - own)[: n - 1, : n - 1] + np.diag([c] * (n - 2) + [0.0])
            b = np.append(np.linalg.lstsq(a, (total - own)[: n - 1, n - 1], rcond=None)[0], -1.0)
            error, count = error + b @ own @ b, count + own[n - 2, n - 2]
        out.append((float(c), float(np.sqrt(max(0.0, error) / max(1.0, count)))))
    return sorted(out, key=lambda x: (x[1], x[0]))


def radial_network(df: DataFrame, features: list[str], target: str, centres: list[list[float]], width: float, ridge: float = 1e-6) -> tuple[dict[str, float], Column]:
    """(coefficients, prediction): a regression on Gaussian units around centres (features scaled by the caller), by one
    aggregation of units x units sums."""
    def unit(c: list[float]) -> Column:
        d = sum(((F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, c, strict=True)), F.lit(0.0))
        return F.exp(-d / (2 * width * width))

    units = {f"_u{i}": unit(c) for i, c in enumerate(centres)}
    beta = least_squares(df.withColumns(units), list(units), target, interactions=False, ridge=ridge)
    return beta, sum((F.lit(beta[k]) * u for k, u in units.items()), F.lit(beta["1"]))


def hinge_regression(df: DataFrame, features: list[str], target: str, knots: int = 8, units: int = 6) -> tuple[list[tuple[str, float, int]], dict[str, float], Column]:
    """(hinges, coefficients, prediction): piecewise linear regression. Hinges max(0, +-(x - knot)) at quantiles of each
    feature are added one at a time, each the one that lessens the squared error most: all candidates' products are
    one aggregation over the rows, and the driver chooses among them."""
    import pandas as pd

    ends = df.agg(*[F.percentile_approx(f, [i / (knots + 1) for i in range(1, knots + 1)], 10000).alias(f) for f in features]).first()
    hinges = [(f, float(k), s) for f in features for k in sorted(set(ends[f] or [])) for s in (1, -1)]
    column = lambda h: F.greatest(F.lit(0.0), h[2] * (F.col(h[0]) - h[1]))
    d = df.where(F.col(target).isNotNull()).dropna(subset=features)
    cols = [F.lit(1.0), *[column(h) for h in hinges], F.col(target).cast("double")]
    n = len(cols)

    def products(batches):
        total = np.zeros((n, n))
        for p in batches:
            x = p.to_numpy(float)
            total += x.T @ x
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    parts = d.select(*[c.cast("double").alias(f"_h{i}") for i, c in enumerate(cols)]).mapInPandas(products, "i long, j long, s double")
    g = np.zeros((n, n))
    for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # n x n numbers
        g[row.i, row.j] = row.s
    chosen = [0]
    solve = lambda c: np.linalg.lstsq(g[np.ix_(c, c)], g[c, -1], rcond=None)[0]
    error = lambda c: g[-1, -1] - g[c, -1] @ solve(c)
    for _ in range(min(units, len(hinges))):
        chosen = min(([*chosen, i] for i in range(1, n - 1) if i not in chosen), key=error)
    beta = dict(zip(chosen, map(float, solve(chosen)), strict=True))
    out = F.lit(beta[0])
    for i in chosen[1:]:
        out = out + beta[i] * column(hinges[i - 1])
    return [hinges[i - 1] for i in chosen[1:]], {str(i): b for i, b in beta.items()}, out


def linear_classifier(df: DataFrame, features: list[str], label: str, rounds: int = 50, penalty: float = 0.01) -> tuple[float, dict[str, float]]:
    """(intercept, weights) of a linear support vector machine for labels 0 and 1, as for pixels of the sun: MLlib's, whose
    rounds sum gradients over all rows in tasks. Rows that are alike count as one with their number as its weight."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    d = df.where(F.col(label).isNotNull()).dropna(subset=features)
    d = d.groupBy(*features, F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    d = kept(VectorAssembler(inputCols=features, outputCol="_x").transform(d).select("_x", "_y", "_w"), "alike")
    m = LinearSVC(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, regParam=penalty).fit(d)
    return float(m.intercept), dict(zip(features, map(float, m.coefficients.toArray()), strict=True))


def tree_ensemble(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 6, seed: int = 5) -> DataFrame:
    """df with prediction: the mean of regression trees, MLlib's, grown on samples of the rows level by level in tasks. Rows
    with a null feature are left out, those without a target are only predicted."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=features))
    known = d.where(F.col(target).isNotNull()).select("_x", F.col(target).cast("double").alias("_y"))
    forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(known)
    return forest.transform(d).drop("_x")


def principal_components(df: DataFrame, vector: str, k: int, rounds: int = 100, gap: float = 1e-8, spare: int = 12, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components (k, d), variances) of a column of vectors of one length, by the power method with deflation.

    A round is one pass over the rows: each task adds up its rows' products with the current directions, the sums meet in
    Spark, and the driver, which holds k directions and some spare ones that hasten the rounds, turns them to the axes of
    the variance they span and takes what lies along earlier ones out of later ones. It ends when what a product has beside
    its own direction is below gap of the first variance. Vectors that are null or hold a null or NaN are left out.
    """
    import pandas as pd

    ok = df.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))).select(F.col(vector).cast("array<double>").alias("_v"))
    first = ok.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d"), F.min(F.size("_v")).alias("least")).first()
    n, d = first["n"], first["d"] or 0
    if n and first["least"] != d:
        raise ValueError("the vectors' lengths differ")
    if not n or not d:
        return np.zeros(d), np.zeros((0, d)), np.zeros(0)

    def summed(make, rows: int) -> np.ndarray:
        """The sum over tasks of make(vectors): rows x d numbers."""

        def run(parts):
            total = np.zeros((rows, d))
            for p in parts:
                if len(p):
                    total += make(np.stack(p["_v"].to_numpy()))
            yield pd.DataFrame({"i": np.arange(rows), "s": list(total)})

        parts = ok.mapInPandas(run, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
        out = np.zeros((rows, d))
        for r in parts.collect():  # rows x d numbers
            out[r["i"], r["j"]] = r["s"]
        return out

    mean = summed(lambda x: x.sum(0)[None], 1)[0] / n
    k, m = min(k, d), min(k + spare, d)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0].T
    for _ in range(rounds):
        w = summed(lambda x, v=v: ((x - mean) @ v.T).T @ (x - mean), m) / max(1, n - 1)
        size, turn = np.linalg.eigh((v @ w.T + w @ v.T) / 2)
        size, turn = size[::-1], turn[:, ::-1].T
        v, w = turn @ v, turn @ w  # w: the covariance times v
        beside = np.linalg.norm(w[:k] - size[:k, None] * v[:k], axis=1).max()
        if beside <= gap * max(size[0], 1e-300):
            break
        v = np.linalg.qr(w.T)[0].T  # each direction less what lies along those before it
    v, size = v[:k], size[:k]
    largest = np.abs(v).argmax(1)
    return mean, v * np.where(v[np.arange(k), largest] < 0, -1, 1)[:, None], size
