"""A network with one hidden layer for autoregression with inputs: fitted by damped Gauss-Newton steps summed over tasks,
predicted by columns, and run on its own output beyond a series' end."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.logs import kept
from .series import lagged


def summed(df: DataFrame, make, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of make(batch): a matrix of so many rows and columns, which the driver gets."""

    def run(batches):
        total = np.zeros((rows, columns))
        for p in batches:
            if len(p):
                total += make(p)
        yield pd.DataFrame({"i": np.arange(rows), "s": list(total)})

    parts = df.mapInPandas(run, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((rows, columns))
    for r in parts.collect():  # rows x columns numbers
        out[r["i"], r["j"]] = r["s"]
    return out


def response(w: np.ndarray, x: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """(output, its slopes by the weights) of rows x, scaled to -1 to 1. Weights in order: a row of each hidden unit (its
    inputs, then its offset), the output's by unit, the output's offset."""
    n, d = x.shape
    first, last = w[: hidden * (d + 1)].reshape(hidden, d + 1), w[hidden * (d + 1) :]
    one = np.column_stack([x, np.ones(n)])
    h = np.tanh(one @ first.T)
    back = (1 - h * h) * last[:-1]
    return h @ last[:-1] + last[-1], np.concatenate([(back[:, :, None] * one[:, None]).reshape(n, -1), h, np.ones((n, 1))], axis=1)


@dataclass
class Network:
    """features and target with the (least, greatest) value of each, the weights as response takes them, root mean squared
    errors (fitted rows, held-out rows) a round in the target's units; without rows, no weights."""

    features: list[str]
    target: str
    ends: dict[str, tuple[float, float]]
    hidden: int
    weights: np.ndarray
    errors: list[tuple[float, float]]

    def column(self, given: dict[str, Column] | None = None) -> Column:
        """The prediction from the features' columns or the given ones; null where one is null or the network is empty."""
        if not len(self.weights):
            return F.lit(None).cast("double")
        d = len(self.features)
        first, last = self.weights[: self.hidden * (d + 1)].reshape(self.hidden, d + 1), self.weights[self.hidden * (d + 1) :]
        x = [_scaled((given or {}).get(c, F.col(c)).cast("double"), *self.ends[c]) for c in self.features]
        out = F.lit(float(last[-1]))
        for unit, share in zip(first, last, strict=False):
            z = F.lit(float(unit[-1]))
            for w, c in zip(unit, x, strict=False):
                z = z + float(w) * c
            out = out + float(share) * F.tanh(z)
        lo, hi = self.ends[self.target]
        return (out + 1) / 2 * (hi - lo) + lo


def _scaled(c, lo: float, hi: float):
    return (c - lo) / (hi - lo) * 2 - 1 if hi > lo else c - lo


def network(df: DataFrame, features: list[str], target: str, id_col: str, hidden: int = 10, rounds: int = 60, patience: int = 6, folds: int = 5, seed: int = 1) -> Network:
    """A network of hidden tanh units and a linear output, of the least squared error that damped Gauss-Newton steps reach.

    A round is two passes over all rows, read from a table in spark.checkpoint.dir: tasks add up the products of the slopes,
    weights x weights numbers, from which the driver solves a step under each of four dampings, and then the errors of
    all four; the best goes on if it lessens the error, else only the damping grows. Rows whose id's crc32 mod folds is 0 are
    held out, and the weights of their least error are kept; fitting ends when it hasn't fallen for patience rounds, or at a
    damping of 1e10. Without held-out rows the fitted ones decide. Rows with a null or NaN in a feature or the target are
    left out; a table without rows gives an empty network.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    d = df.select((F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0).alias("_out"), *[number(c).alias(f"_{i}") for i, c in enumerate([*features, target])])
    d = kept(d.dropna(subset=[c for c in d.columns if c != "_out"]).fillna(False, ["_out"]), "network")
    names = [*features, target]
    got = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_out").cast("long")).alias("m"), *[f(f"_{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not got["n"] or got["n"] == got["m"]:
        return Network(features, target, {}, hidden, np.zeros(0), [])
    ends = {c: (got[f"lo{i}"], got[f"hi{i}"]) for i, c in enumerate(names)}
    size = hidden * (len(features) + 2) + 1

    def numbers(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([_scaled(p[f"_{i}"].to_numpy(float), *ends[c]) for i, c in enumerate(features)])
        return x, _scaled(p[f"_{len(features)}"].to_numpy(float), *ends[target]), p["_out"].to_numpy(bool)

    def products(p: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        x, y, out = numbers(p)
        f, j = response(w, x[~out], hidden)
        return j.T @ np.column_stack([j, y[~out] - f])

    def squares(p: pd.DataFrame, several: list[np.ndarray]) -> np.ndarray:
        x, y, out = numbers(p)
        e = np.array([(y - response(w, x, hidden)[0]) ** 2 for w in several])
        return np.column_stack([e[:, ~out].sum(axis=1), e[:, out].sum(axis=1)])

    g = np.random.default_rng(seed)
    w = np.concatenate([g.uniform(-1, 1, hidden * (len(features) + 1)) * (1.4 / max(1, len(features)) ** 0.5), g.uniform(-0.5, 0.5, hidden + 1)])
    damping, now = 1e-2, summed(d, lambda p, w=w: squares(p, [w]), 1, 2)[0]
    judged = 1 if got["m"] else 0
    best, least, since, steps = w, now[judged], 0, None
    unit = (ends[target][1] - ends[target][0]) / 2 or 1.0
    shown = lambda e: (unit * (e[0] / (got["n"] - got["m"])) ** 0.5, unit * (e[1] / got["m"]) ** 0.5 if got["m"] else float("nan"))
    errors = [shown(now)]
    for _ in range(rounds):
        if steps is None:
            steps = summed(d, lambda p, w=w: products(p, w), size, size + 1)
        a, b = steps[:, :-1], steps[:, -1]
        tried = [damping * 10.0**k for k in (-2, -1, 0, 1)]
        several = [w + np.linalg.solve(a + t * (np.diag(np.diag(a)) + 1e-9 * np.trace(a) / size * np.eye(size)) + 1e-12 * np.eye(size), b) for t in tried]
        e = summed(d, lambda p, s=several: squares(p, s), 4, 2)
        i = int(np.nanargmin(np.where(np.isfinite(e[:, 0]), e[:, 0], np.inf)))
        if e[i, 0] < now[0]:
            gain, w, now, damping, steps = 1 - e[i, 0] / now[0], several[i], e[i], max(tried[i], 1e-10), None
            errors.append(shown(now))
            if now[judged] < least:
                best, least, since = w, now[judged], 0
            else:
                since += 1
            if since >= patience or gain < 1e-9:
                break
        else:
            damping *= 1e3
            if damping > 1e10:
                break
    return Network(features, target, ends, hidden, best, errors)


def lag_features(value: str, lags: list[int], inputs: list[str], input_lags: list[int]) -> list[str]:
    return [*(f"{value}_{i}" for i in lags), *(f"{c}_{i}" for c in inputs for i in input_lags)]


def autoregressive_network(df: DataFrame, key: list[str], order: list[str], value: str, lags: list[int], id_col: str, inputs: list[str] = (), input_lags: list[int] = (), **given) -> tuple[Network, DataFrame]:
    """(network, df with y_hat): value by the values, and the inputs, of a series' rows before it (lags from 1 up)."""
    d = lagged(df, key, order, [value], list(lags))
    if inputs:
        d = lagged(d, key, order, list(inputs), list(input_lags))
    net = network(d, lag_features(value, lags, inputs, input_lags), value, id_col, **given)
    return net, d.select(*df.columns, net.column().alias("y_hat"))


def forecast(df: DataFrame, net: Network, key: list[str], order: list[str], value: str, lags: list[int], steps: int, inputs: list[str] = (), input_lags: list[int] = (), known: DataFrame | None = None) -> DataFrame:
    """key, step, y_hat: each series steps rows beyond its end, the network's outputs becoming inputs (a closed loop).

    The last values of a series come from lags in ranges and a maximum by order, so that a long series is many tasks. known
    (key, step from 1, inputs) has the inputs to come; without them, or where a lag is not there, y_hat is null, as are
    the steps that need it. steps are few: a series' are folded in one row. Keys are compared null-safe.
    """
    most, far = max(lags), max(input_lags, default=1)
    names = {"_y": (value, most)} | {f"_x{i}": (c, far) for i, c in enumerate(inputs)}
    d = df.select(*key, *order, *[F.col(c).cast("double").alias(n) for n, (c, _) in names.items()])
    if (reach := max(most, far)) > 1:
        d = lagged(d, key, order, list(names), list(range(1, reach)))
    row = F.struct(*[F.array(F.col(n), *[F.col(f"{n}_{i}") for i in range(1, size)]).alias(n) for n, (_, size) in names.items()])
    last = d.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    if inputs:
        to_come = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)]
        k = known.where(F.col("step").between(1, steps)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.struct(F.col("step").cast("int").alias("step"), F.struct(*to_come).alias("x")).alias("e"))
        k = k.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.map_from_entries(F.collect_list("e")).alias("_known"))
        on = F.lit(True)
        for i, c in enumerate(key):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        last = last.join(k, on, "left")

    def one(state: Column, step: Column) -> Column:
        """A step: arrays begin with the newest row; the prediction goes before the values, the step's inputs before theirs."""
        x = {f"{value}_{i}": state["_y"][i - 1] for i in lags} | {f"{c}_{j}": state[f"_x{i}"][j - 1] for i, c in enumerate(inputs) for j in input_lags}
        y = net.column(x)
        pushed = [F.slice(F.concat(F.array(y), state["_y"]), 1, most).alias("_y")]
        pushed += [F.slice(F.concat(F.array(F.try_element_at(F.col("_known"), step)[f"_x{i}"]), state[f"_x{i}"]), 1, far).alias(f"_x{i}") for i in range(len(inputs))]
        return F.struct(*pushed, F.concat(state["_out"], F.array(y)).alias("_out"))

    start = F.struct(*[F.col("_last")[n].alias(n) for n in names], F.array().cast("array<double>").alias("_out"))
    out = last.select(*key, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, one, lambda s: s["_out"]).alias("_o"))
    return out.select(*key, F.posexplode("_o").alias("_i", "y_hat")).select(*key, (F.col("_i") + 1).alias("step"), "y_hat")
