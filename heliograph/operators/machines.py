"""Kernel and sparse regressions whose unknowns are as many as their training rows: these are a sample of a stated size, the
same for any partitioning; their kernels are made in blocks in tasks, and every row is predicted."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drawn(df: DataFrame, columns: list[str], id_col: str, most: int, seed: int = 1) -> np.ndarray:
    """Up to most rows of df without nulls, those of the least md5(seed|id), as an array; the driver's, most rows at most."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = df.dropna(subset=columns).select(h.alias("_h"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    names = [f"_{i}" for i in range(len(columns))]
    return np.array([[r[k] for k in names] for r in rows.orderBy("_h", *names).limit(most).collect()], float).reshape(-1, len(columns))


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |a - b|^2) + 1; the constant stands for the intercept."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0)) + 1


def descend(k: np.ndarray, g: np.ndarray, beta: np.ndarray, epsilon: float, c: float, sweeps: int, least: float = 0.0) -> np.ndarray:
    """New values of beta after sweeps of coordinate descent on the dual of the epsilon-insensitive machine; g is the gradient of
    its smooth part and is kept up to date. Ends when a sweep moves none by more than least."""
    beta = beta.copy()
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(beta)):
            q = k[i, i]
            z = beta[i] - g[i] / q
            new = min(max(np.sign(z) * max(abs(z) - epsilon / q, 0.0), -c), c)
            t = new - beta[i]
            if t:
                g += t * k[i]
                beta[i] = new
                moved = max(moved, abs(t))
        if moved <= least:
            break
    return beta


def duality(f: np.ndarray, y: np.ndarray, beta: np.ndarray, epsilon: float, c: float) -> tuple[float, float]:
    """Primal and dual value of the machine whose fitted values are f."""
    norm = float(beta @ f)
    return 0.5 * norm + c * np.maximum(0, np.abs(f - y) - epsilon).sum(), float(y @ beta - epsilon * np.abs(beta).sum() - 0.5 * norm)


@dataclass
class Machine:
    """A fitted kernel machine: f(x) = offset + sum beta_i k(x_i, x)."""

    x: np.ndarray
    beta: np.ndarray
    offset: float
    gamma: float
    gap: float  # primal less dual value, as a share of the primal's
    rounds: int

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.offset + (kernel(x, self.x, self.gamma) @ self.beta if len(self.beta) else np.zeros(len(x)))

    def predict(self, df: DataFrame, features: list[str]) -> DataFrame:
        """df with y_hat, null where a feature is."""

        def run(parts):
            for p in parts:
                x = p[features].to_numpy(float)
                out = np.concatenate([np.zeros(0), *(self.values(x[i : i + 4096]) for i in range(0, len(x), 4096))])
                yield p.assign(y_hat=pd.Series(out, p.index).where(~np.isnan(x).any(axis=1)))

        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("y_hat", T.DoubleType())]))


def violation(g: np.ndarray, beta: np.ndarray, epsilon: float, c: float) -> np.ndarray:
    """How far each unknown is from its optimality condition; 0 where it holds."""
    v = np.where(beta > 0, g + epsilon, np.where(beta < 0, g - epsilon, np.sign(g) * np.maximum(np.abs(g) - epsilon, 0)))
    return np.where((beta >= c) & (v < 0) | (beta <= -c) & (v > 0), 0.0, np.abs(v))


def epsilon_machine(df: DataFrame, features: list[str], target: str, id_col: str, *, c: float = 250.0, epsilon: float = 9.0, gamma: float = 8.0, most: int = 20_000, block: int = 1000, gap: float = 1e-3, rounds: int = 500) -> Machine:
    """An epsilon-insensitive regression with a radial kernel, by decomposition of its dual.

    The training rows are most at most. In every round the block of unknowns that are furthest from optimal is solved by
    itself, in a task; then the kernel of all rows with the block is made and multiplied by the change, rows dealt over
    tasks. The driver holds two numbers a row. It ends when primal and dual values are within gap of each other.
    """
    spark = df.sparkSession
    data = drawn(df, [*features, target], id_col, most)
    x, offset = data[:, :-1], float(data[:, -1].mean()) if len(data) else 0.0
    y, n = data[:, -1] - offset, len(data)
    parts_n = max(1, -(-n // block))
    part = [slice(i * n // parts_n, (i + 1) * n // parts_n) for i in range(parts_n)]
    shared = spark.sparkContext.broadcast(x)  # most rows of the features

    def over(m: int, run) -> np.ndarray:
        """run(0) .. run(m - 1), each in a task, one after the other."""

        def each(parts):
            for p in parts:
                for b in p["id"]:
                    v = run(int(b))
                    yield pd.DataFrame({"b": b, "i": np.arange(len(v)), "v": v})

        return spark.range(m).repartition(m, "id").mapInPandas(each, "b long, i long, v double").toPandas().sort_values(["b", "i"])["v"].to_numpy()

    beta, f, done = np.zeros(n), np.zeros(n), 0
    share = 1.0 if n else 0.0
    while n and done < rounds and share > gap:
        g = f - y
        work = np.sort(np.argsort(-violation(g, beta, epsilon, c), kind="stable")[:block])

        def solved(_, g=g[work], old=beta[work], work=work):
            own = shared.value[work]
            return descend(kernel(own, own, gamma), g.copy(), old, epsilon, c, 1000, 1e-7 * c)

        new = over(1, solved)

        def times(b, step=new - beta[work], work=work):
            return kernel(shared.value[part[b]], shared.value[work], gamma) @ step

        f, done = f + over(parts_n, times), done + 1
        beta[work] = new
        primal, dual = duality(f, y, beta, epsilon, c)
        share = (primal - dual) / max(abs(primal), 1e-12)
    shared.unpersist()
    used = beta != 0
    return Machine(x[used], beta[used], offset, gamma, float(share), done)


def machine_grid(df: DataFrame, features: list[str], target: str, id_col: str, epsilons: list[float], gammas: list[float], cs: list[float], *, folds: int = 5, most: int = 1000, sweeps: int = 300) -> DataFrame:
    """epsilon, gamma, c, rmse for each point of the grid: cross-validation of the epsilon-insensitive machine on up to most
    rows; a row's fold is its place in the sample. Every point and fold is a task's work of its own."""
    spark = df.sparkSession
    data = drawn(df, [*features, target], id_col, most)
    shared = spark.sparkContext.broadcast(data)  # most rows
    grid = spark.createDataFrame([(float(e), float(g), float(c), k) for e in epsilons for g in gammas for c in cs for k in range(folds)], "epsilon double, gamma double, c double, fold int")

    def run(parts):
        for p in parts:
            d, out = shared.value, []
            at = np.arange(len(d)) % folds
            for e, g, c, k in zip(p["epsilon"], p["gamma"], p["c"], p["fold"], strict=True):
                own, rest = d[at == k], d[at != k]
                if not len(own) or not len(rest):
                    out.append((0, 0.0))
                    continue
                mean = rest[:, -1].mean()
                y = rest[:, -1] - mean
                beta = descend(kernel(rest[:, :-1], rest[:, :-1], g), -y, np.zeros(len(y)), e, c, sweeps, 1e-4 * c)
                error = own[:, -1] - mean - kernel(own[:, :-1], rest[:, :-1], g) @ beta
                out.append((len(own), float(error @ error)))
            yield p.assign(n=[n for n, _ in out], sse=[s for _, s in out])

    scored = grid.repartition(grid.count()).mapInPandas(run, "epsilon double, gamma double, c double, fold int, n long, sse double")
    return scored.groupBy("epsilon", "gamma", "c").agg(F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("rmse"))


def relevance(df: DataFrame, features: list[str], target: str, id_col: str, *, gamma: float = 1.0, most: int = 2000, rounds: int = 500, least: float = 1e-6) -> tuple[Machine, float]:
    """(machine, noise variance) of a relevance vector regression on up to most rows: a Gaussian prior with a precision of its
    own on every basis function, chosen by the evidence; those that the evidence doesn't ask for are left out.

    One sequential addition, re-estimate or removal a round, the one that raises the evidence most. The sums over rows, basis
    by basis, are made in tasks; the driver holds these numbers, most squared at most.
    """
    spark = df.sparkSession
    data = drawn(df, [*features, target], id_col, most)
    n = len(data)
    if not n:
        return Machine(data[:, :-1], np.zeros(0), 0.0, gamma, 0.0, 0), 0.0
    x, offset = data[:, :-1], float(data[:, -1].mean())
    y = data[:, -1] - offset
    shared = spark.sparkContext.broadcast(x)

    def rows(parts):
        for p in parts:
            for i in p["id"]:
                own = slice(i * 256, min(n, (i + 1) * 256))
                k = kernel(shared.value[own], shared.value, gamma)
                gram = kernel(shared.value, shared.value[own], gamma).T @ kernel(shared.value, shared.value, gamma)
                yield pd.DataFrame({"i": np.arange(own.start, own.stop), "k": list(k), "g": list(gram)})

    blocks = -(-n // 256)
    got = spark.range(blocks).repartition(blocks, "id").mapInPandas(rows, "i long, k array<double>, g array<double>").toPandas().sort_values("i")
    phi, gram = np.stack(got["k"].tolist()), np.stack(got["g"].tolist())
    shared.unpersist()
    beta, used, alpha, noise = evidence(phi, gram, y, rounds, least)
    return Machine(x[used], beta, offset, gamma, 0.0, len(alpha)), noise


def evidence(phi: np.ndarray, gram: np.ndarray, y: np.ndarray, rounds: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, basis functions used, their precisions, noise variance) that raise the marginal likelihood of y = phi w + noise.

    gram is phi' phi. s and q of a basis function say how much it overlaps with the others and how well it points at what they
    leave; its best precision is s^2 / (q^2 - s) if positive, else it is left out.
    """
    n = len(y)
    to_y, norm = phi.T @ y, np.diag(gram)
    noise = max(1e-12, 0.1 * float(y @ y) / n)
    used = [int(np.argmax(to_y * to_y / norm))]
    u = used[0]
    alpha = [float(norm[u] / max(1e-12, to_y[u] ** 2 / norm[u] - noise))]
    mean = np.zeros(1)
    for k in range(rounds):
        a = np.array(alpha)
        cov = np.linalg.inv(np.diag(a) + gram[np.ix_(used, used)] / noise)
        mean = cov @ to_y[used] / noise
        if k % 5 == 4:  # the noise, from time to time
            rest = float(y @ y - 2 * mean @ to_y[used] + mean @ gram[np.ix_(used, used)] @ mean)
            new = max(1e-12, rest / max(1e-9, n - len(used) + (a * np.diag(cov)).sum()))
            change, noise = abs(np.log(new / noise)), new
            cov = np.linalg.inv(np.diag(a) + gram[np.ix_(used, used)] / noise)
            mean = cov @ to_y[used] / noise
        else:
            change = np.inf
        side = gram[:, used]
        big_s = norm / noise - np.einsum("ij,jk,ik->i", side, cov, side) / noise**2
        big_q = to_y / noise - side @ mean / noise
        s, q = big_s.copy(), big_q.copy()
        s[used], q[used] = a * big_s[used] / (a - big_s[used]), a * big_q[used] / (a - big_s[used])
        theta = q * q - s
        gain = np.full(len(norm), -np.inf)
        out = np.ones(len(norm), bool)
        out[used] = False
        add = out & (theta > 0)
        gain[add] = (big_q[add] ** 2 - big_s[add]) / big_s[add] + np.log(big_s[add] / big_q[add] ** 2)
        for j, i in enumerate(used):
            if theta[i] > 0:
                d = theta[i] / s[i] ** 2 - 1 / a[j]
                gain[i] = big_q[i] ** 2 / (big_s[i] + 1 / d) - np.log1p(big_s[i] * d) if abs(d) > 1e-300 else 0.0
            elif len(used) > 1:
                gain[i] = big_q[i] ** 2 / (big_s[i] - a[j]) - np.log(1 - big_s[i] / a[j])
        i = int(np.nanargmax(gain))
        if not gain[i] > least and change < 1e-4:
            break
        if not gain[i] > least:
            continue
        if theta[i] > 0:
            best = float(s[i] ** 2 / theta[i])
            if i in used:
                alpha[used.index(i)] = best
            else:
                used.append(i)
                alpha.append(best)
        else:
            j = used.index(i)
            del used[j], alpha[j]
    cov = np.linalg.inv(np.diag(alpha) + gram[np.ix_(used, used)] / noise)
    return cov @ to_y[used] / noise, np.array(used), np.array(alpha), noise
