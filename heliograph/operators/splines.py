"""Adaptive regression splines: products of hinges, added in pairs by sums over all rows and pruned by cross-validation's
approximation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.logs import kept
from .networks import summed

Term = tuple[tuple[int, float, int], ...]  # hinges max(0, side * (feature - knot)): feature's place, knot, side


@dataclass
class Splines:
    """coefficients by term, the empty term being the intercept; error: the mean squared error of the fitted rows; gcv: this,
    raised for the number of terms."""

    features: list[str]
    terms: list[Term]
    coefficients: list[float]
    error: float
    gcv: float

    def column(self) -> Column:
        """The prediction; null where a feature that a term uses is null or NaN, or where there were no rows."""
        if not self.terms:
            return F.lit(None).cast("double")
        out = F.lit(0.0)
        for term, c in zip(self.terms, self.coefficients, strict=True):
            part = F.lit(float(c))
            for i, knot, side in term:
                x = F.col(self.features[i]).cast("double")
                part = part * F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), side * (x - knot)))
            out = out + part
        return out


def unfolded(x: np.ndarray, term: Term) -> np.ndarray:
    """A term's values at rows x."""
    out = np.ones(len(x))
    for i, knot, side in term:
        out = out * np.maximum(0.0, side * (x[:, i] - knot))
    return out


def _pairs(terms: list[Term], knots: list[list[float]], degree: int) -> list[tuple[Term, int, float]]:
    """What may be added: (parent, feature, knot), each giving a hinge to either side."""
    return [(t, i, k) for t in terms if len(t) < degree for i, ks in enumerate(knots) if all(i != h[0] for h in t) for k in ks]


def _solved(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least solution of symmetric equations whose columns are brought to one length first."""
    s = np.sqrt(np.maximum(np.diag(g), 1e-300))
    out = np.linalg.lstsq(g / np.outer(s, s), (b.T / s).T, rcond=1e-12)[0]
    return (out.T / s).T


def _best_pair(g: np.ndarray, b: np.ndarray, q: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """(how much the squared error falls, place) of the pair that lessens it most, the first of equals. A pair's hinges are
    rows 2i and 2i + 1 of q (products with the basis), own (with themselves) and y (with the target); their product is 0. What
    the basis has already of a hinge, within rounding, adds nothing."""
    p = _solved(g, q.T)
    r, s = y - p.T @ b, own - (q * p.T).sum(axis=1)
    free = s > 1e-9 * np.maximum(own, 1e-300)
    s, r = np.where(free, s, 1.0), np.where(free, r, 0.0)
    cross = np.where(free[::2] & free[1::2], -(q[::2] * p.T[1::2]).sum(axis=1), 0.0)
    det = s[::2] * s[1::2] - cross * cross
    alone = np.maximum(r[::2] ** 2 / s[::2], r[1::2] ** 2 / s[1::2])
    both = (r[::2] ** 2 * s[1::2] - 2 * r[::2] * r[1::2] * cross + r[1::2] ** 2 * s[::2]) / np.where(det > 0, det, 1.0)
    gain = np.where(det > 1e-9 * s[::2] * s[1::2], both, alone)
    i = int(np.flatnonzero(gain >= gain.max() * (1 - 1e-12))[0])
    return float(gain[i]), i


def pruned(g: np.ndarray, b: np.ndarray, total: float, n: float, penalty: float) -> tuple[list[int], float, float]:
    """(places kept, squared error, gcv): terms are dropped one by one, each the one whose loss raises the squared error
    least, down to the intercept; of all these models the one of least gcv. From sums of products alone."""

    def error(use: list[int]) -> float:
        return max(0.0, float(total - b[use] @ _solved(g[np.ix_(use, use)], b[use])))

    def gcv(e: float, m: int) -> float:
        left = 1 - (m + penalty * (m - 1) / 2) / n
        return e / n / left**2 if left > 0 else float("inf")

    use = list(range(len(b)))
    models = [(use, error(use))]
    while len(use) > 1:
        use, e = min((([*use[:i], *use[i + 1 :]], error([*use[:i], *use[i + 1 :]])) for i in range(1, len(use))), key=lambda m: m[1])
        models.append((use, e))
    use, e = min(models, key=lambda m: (gcv(m[1], len(m[0])), len(m[0])))
    return use, e, gcv(e, len(use))


def adaptive_splines(df: DataFrame, features: list[str], target: str, knots: int | dict[str, list[float]] = 8, most: int = 21, degree: int = 2, penalty: float = 3.0, least_gain: float = 1e-4, prune: bool = True) -> Splines:
    """Regression on products of up to degree hinges of different features, of at most `most` terms.

    From the intercept on, each round adds the pair of hinges, to either side of a knot and times a term that is there,
    that lessens the squared error most, until the share of the variance it explains is under least_gain. A round is one
    pass over all rows, read from a table in spark.checkpoint.dir: tasks add up the products of every candidate with the
    terms and the target, candidates x terms numbers, and the driver chooses. The terms are then pruned from the same sums.

    Knots are each feature's quantiles, or as given; those without a row to one side add that side as 0, which is left out.
    Rows with a null or NaN in a feature or the target are left out; a table without rows gives an empty model.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    d = kept(df.select(*[number(c).alias(f"_{i}") for i, c in enumerate([*features, target])]).dropna(), "splines")
    y = f"_{len(features)}"
    quantiles = [] if isinstance(knots, dict) else [F.percentile_approx(f"_{i}", [k / (knots + 1) for k in range(1, knots + 1)], 10000).alias(f"q{i}") for i in range(len(features))]
    ends = [f(f"_{i}").alias(f"{n}{i}") for i in range(len(features)) for n, f in (("lo", F.min), ("hi", F.max))]
    got = d.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"), *ends, *quantiles).first()
    n = got["n"]
    if not n:
        return Splines(features, [], [], float("nan"), float("nan"))
    lows = np.array([got[f"lo{i}"] for i in range(len(features))])
    spans = np.array([got[f"hi{i}"] - got[f"lo{i}"] or 1.0 for i in range(len(features))])
    places = [sorted(set(knots[c] if isinstance(knots, dict) else got[f"q{i}"])) for i, c in enumerate(features)]
    scaled = [[(k - lows[i]) / spans[i] for k in ks] for i, ks in enumerate(places)]  # features run from 0 to 1 from here
    back = {(i, s): k for i, ks in enumerate(places) for k, s in zip(ks, scaled[i], strict=True)}
    mean, total = got["mean"], got["var"] * n

    def products(p: pd.DataFrame, terms: list[Term], pairs: list) -> np.ndarray:
        x, out = (p.iloc[:, :-1].to_numpy(float) - lows) / spans, np.zeros((2 * len(pairs), len(terms) + 2))
        z = np.column_stack([*(unfolded(x, t) for t in terms), p[y].to_numpy(float) - mean])
        parents = {t: z[:, i] for i, t in enumerate(terms)}
        for j, (t, i, k) in enumerate(pairs):
            for side, at in ((1, 2 * j), (-1, 2 * j + 1)):
                c = parents[t] * np.maximum(0.0, side * (x[:, i] - k))
                out[at, :-1], out[at, -1] = c @ z, c @ c
        return out

    terms, g, b, left = [()], np.array([[float(n)]]), np.zeros(1), total
    while len(terms) < most and left > 0 and (pairs := _pairs(terms, scaled, degree)):
        s = summed(d, lambda p, t=list(terms), c=pairs: products(p, t, c), 2 * len(pairs), len(terms) + 2)
        q, to_y, own = s[:, :-2], s[:, -2], s[:, -1]
        gain, at = _best_pair(g, b, q, own, to_y)
        if gain < least_gain * total:
            break
        parent, i, k = pairs[at]
        for side, row in ((1, 2 * at), (-1, 2 * at + 1)):
            new = np.append(q[row], np.zeros(len(terms) - q.shape[1]))  # with its twin a hinge has no product
            rest = own[row] - new @ _solved(g, new)
            if len(terms) < most and rest > 1e-9 * max(own[row], 1e-300):
                g = np.block([[g, new[:, None]], [new[None], own[row]]])
                b, terms = np.append(b, to_y[row]), [*terms, (*parent, (i, k, side))]
        left = max(0.0, total - b @ _solved(g, b))
    use, error, gcv = pruned(g, b, total, n, penalty) if prune else (list(range(len(terms))), left, float("nan"))
    beta = _solved(g[np.ix_(use, use)], b[use])
    beta[0] += mean
    plain = [tuple((i, back[i, k], side) for i, k, side in terms[u]) for u in use]
    sizes = [float(np.prod([spans[i] for i, _, _ in t])) for t in plain]
    return Splines(features, plain, [float(c / z) for c, z in zip(beta, sizes, strict=True)], error / n, gcv)
