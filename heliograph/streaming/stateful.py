"""Structured Streaming operators: minute aggregates, delayed scoring, filters and expert weights with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import least_cost


def minute_stream(stream: DataFrame, key: list[str], ts: str, value: str, late: str = "10 minutes") -> DataFrame:
    """key, start, v, n: means per minute of event time, closed by a watermark."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), *key).agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    return w.select(*key, F.col("window.start").alias("start"), "v", "n")


def within_hours(stream: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """The rows from first up to before last ("HH:mm") of each day; over midnight where last is earlier. When to run is the
    trigger's matter."""
    at = F.date_format(ts, "HH:mm")
    return stream.where((at >= first) & (at < last) if first <= last else (at >= first) | (at < last))


def sliding_stream(stream: DataFrame, key: list[str], ts: str, value: str, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """key, start, v, n: means per window of event time that begins every step."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, length, step), *key).agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    return w.select(*key, F.col("window.start").alias("start"), "v", "n")


def session_stream(stream: DataFrame, key: list[str], ts: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, start, n, total: rows of a key that follow each other within gap."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(*key, F.col("session_window.start").alias("start"), "n", "total")


def median_stream(stream: DataFrame, key: str, ts: str, value: str, n: int) -> DataFrame:
    """key, ts, v, n: the median of the last n values at each row, in order of ts per batch and key; the state is those values."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        p, v, m = pd.concat(list(frames)).sort_values([ts, value]), [], []
        for x in p[value].to_numpy(float):
            kept = [*kept, float(x)][-n:]
            v.append(float(np.median(kept)))
            m.append(len(kept))
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]] * len(p), ts: p[ts].to_numpy(), "v": v, "n": m})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, v double, n long", "kept array<double>", "append", "NoTimeout")


def delayed_scores(predictions: DataFrame, truth: DataFrame, key: list[str], horizon: str, late: str = "10 minutes") -> DataFrame:
    """key, ts, predicted, actual, error: every prediction (key, ts, predicted) meets the truth (key, ts, actual) of ts + horizon.

    Works on streams and on tables; on streams both sides' state ends with their watermarks.
    """
    p = predictions.withColumn("due", F.col("ts") + F.expr(f"INTERVAL {horizon}")).alias("p")
    t = truth.alias("t")
    if predictions.isStreaming:
        p, t = predictions.withColumn("due", F.col("ts") + F.expr(f"INTERVAL {horizon}")).withWatermark("due", late).alias("p"), truth.withWatermark("ts", late).alias("t")
    on = F.col("p.due") == F.col("t.ts")
    for c in key:
        on = on & (F.col(f"p.{c}") == F.col(f"t.{c}"))
    return p.join(t, on).select(*[F.col(f"p.{c}").alias(c) for c in key], F.col("p.ts").alias("ts"), "predicted", "actual", (F.col("predicted") - F.col("actual")).alias("error"))


def kalman_step(x, cov, last, u, z, q, r):
    """(state, covariance, u of the last measured row, y) after one row; a NaN z only predicts."""
    if np.isnan(last):
        last = u
    if np.isnan(z):
        return x, cov, last, float(x[0] * u + x[1] * u * u)
    prior = cov + q * np.eye(2)
    c = np.array([last, last * last])
    gain = prior @ c / (c @ prior @ c + r)
    x = x + gain * (z - (x[0] * u + x[1] * u * u))
    return x, (np.eye(2) - np.outer(gain, c)) @ prior, u, float(x[0] * u + x[1] * u * u)


def kalman_stream(stream: DataFrame, key: str, ts: str, u: str, z: str, x0=(3.0, -0.00053), p0=(1e-5, 1e-9), q: float = 1e-10, r: float = 10.0) -> DataFrame:
    """key, ts, y of a stream in order of ts per batch and key; the state per key is two vectors and the last input."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            s = state.get
            x, cov, last = np.array(s[:2]), np.array(s[2:6]).reshape(2, 2), s[6]
        else:
            x, cov, last = np.array(x0, float), np.diag(p0).astype(float), float("nan")
        p = pd.concat(list(frames)).sort_values([ts, u])
        out = []
        for a, b in zip(p[u].to_numpy(float), p[z].to_numpy(float), strict=True):
            x, cov, last, y = kalman_step(x, cov, last, a, b, q, r)
            out.append(y)
        state.update((*map(float, x), *map(float, cov.ravel()), float(last)))
        yield pd.DataFrame({key: [k[0]] * len(p), ts: p[ts].to_numpy(), "y": out})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    state = ", ".join(f"{n} double" for n in ("x1", "x2", "c11", "c12", "c21", "c22", "last"))
    return stream.select(key, ts, u, z).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, y double", state, "append", "NoTimeout")


def onto_simplex(x: np.ndarray) -> np.ndarray:
    u = np.sort(x)[::-1]
    shift = (1 - np.cumsum(u)) / np.arange(1, len(u) + 1)
    return np.maximum(x + shift[np.flatnonzero(u + shift > 0)[-1]], 0)


def expert_stream(scored: DataFrame, key: str, experts: list[str], actual: str, rate: float = 0.01) -> DataFrame:
    """key, n, weights after each batch: online weights of experts by projected gradient steps on the squared error."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, w = state.get if state.exists else (0, [1 / len(experts)] * len(experts))
        w = np.array(w, float)
        for p in frames:
            for f, y in zip(p[experts].to_numpy(float), p[actual].to_numpy(float), strict=True):
                w = onto_simplex(w - rate * 2 * (w @ f - y) * f)
                n += 1
        state.update((n, w.tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [n], "weights": [w.tolist()]})

    kind = scored.schema[key].dataType.simpleString()
    return scored.select(key, *experts, actual).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, weights array<double>", "n long, weights array<double>", "update", "NoTimeout")


def forgetting_stream(scored: DataFrame, key: str, ts: str, experts: list[str], actual: str, forget: float = 0.05, share: float = 0.1) -> DataFrame:
    """key, ts, predicted: experts' mean weighted by exp(-s / q), s being an expert's forgetting mean of absolute errors above
    the least one's and q their Hazen quantile at share (0: only the least count), in order of ts per batch and key. The
    errors count after the prediction; an expert without a value has the others' mean error. Without any expert: null."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = np.array(state.get[0] if state.exists else [0.0] * len(experts))
        p, out = pd.concat(list(frames)).sort_values([ts, actual, *experts]), []
        for f, y in zip(p[experts].to_numpy(float), p[actual].to_numpy(float), strict=True):
            ok = ~np.isnan(f)
            if not ok.any():
                out.append(None)
                continue
            over = s[ok] - s[ok].min()
            q = float(np.quantile(over, share, method="hazen"))
            w = np.exp(-over / q) if q > 0 else (over == 0).astype(float)
            out.append(float(w @ f[ok] / w.sum()))
            if not np.isnan(y):
                e = np.where(ok, np.abs(f - y), 0.0)
                s = (1 - forget) * s + forget * np.where(ok, e, e[ok].mean())
        state.update((s.tolist(),))
        yield pd.DataFrame({key: [k[0]] * len(p), ts: p[ts].to_numpy(), "predicted": pd.Series(out, dtype="float64")})

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    return scored.select(key, ts, *experts, actual).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, predicted double", "s array<double>", "append", "NoTimeout")


def track_stream(detections: DataFrame, key: str, ts: str, x: str, y: str, *, order: int = 2, alone: float = 30.0, noise: float = 1.0, drift: float = 0.1, longest: int = 900, young: int = 8, visible: float = 0.8) -> DataFrame:
    """key, ts, x, y, track: what moves before each camera (key), numbered from 0. Rows of one ts are a frame, frames come in
    order; a frame without detections is a row without x or y.

    A track predicts its place by a Kalman filter of constant speed (order 2) or acceleration (3). A frame's detections go
    to the tracks at the least total of normalised squared distances and log variances, or, above alone, begin new ones. A
    track ends after longest frames unseen, or if younger than young frames and seen in less than visible of them. The
    state is a camera's open tracks.
    """
    step = np.array([[1.0, 1.0, 0.5], [0, 1, 1], [0, 0, 1]])[:order, :order]

    def frame(tracks: list[dict], at: np.ndarray, fresh: int) -> tuple[list[dict], list[int], int]:
        for t in tracks:
            t["m"] = step @ np.array(t["m"])  # rows: place, speed, ...; columns: x, y
            t["c"] = step @ np.array(t["c"]) @ step.T + drift * np.eye(order)
            t["age"], t["missed"] = t["age"] + 1, t["missed"] + 1
        ids = [-1] * len(at)
        if tracks and len(at):
            var = np.array([t["c"][0, 0] + noise for t in tracks])
            gap = np.array([((at - t["m"][0]) ** 2).sum(axis=1) for t in tracks])
            for i, j in zip(*least_cost(gap / var[:, None] + 2 * np.log(var)[:, None], alone / 2), strict=True):
                t = tracks[i]
                gain = t["c"][:, :1] / var[i]
                t["m"] = t["m"] + gain * (at[j] - t["m"][0])
                t["c"] = t["c"] - gain @ t["c"][:1]
                t["seen"], t["missed"], ids[j] = t["seen"] + 1, 0, t["id"]
        kept = [t for t in tracks if t["missed"] < longest and not (t["age"] < young and t["seen"] < visible * t["age"])]
        for j, place in enumerate(at):
            if ids[j] < 0:
                ids[j] = fresh
                kept.append({"id": fresh, "age": 1, "seen": 1, "missed": 0, "m": np.vstack([place, np.zeros((order - 1, 2))]), "c": np.eye(order) * 10 * noise})
                fresh += 1
        return kept, ids, fresh

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracks, fresh = json.loads(state.get[0]) if state.exists else ([], 0)
        p = pd.concat(list(frames)).sort_values([ts, x, y])
        p = p[p[ts].notna()]
        at, found = p[[x, y]].to_numpy(float), []
        known, new = ~np.isnan(at).any(axis=1), p[ts].ne(p[ts].shift()).to_numpy()
        edges = [*np.flatnonzero(new), len(p)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):  # arrays only: a frame has few rows
            tracks, ids, fresh = frame(tracks, at[i:j][known[i:j]], fresh)
            found += ids
        plain = [t | {"m": np.asarray(t["m"]).tolist(), "c": np.asarray(t["c"]).tolist()} for t in tracks]
        state.update((json.dumps([plain, fresh]),))
        yield p[known].assign(track=np.array(found, np.int64))[[key, ts, x, y, "track"]]

    kinds = {f.name: f.dataType.simpleString() for f in detections.schema}
    return detections.select(key, ts, x, y).groupBy(key).applyInPandasWithState(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, ts, x, y)), "track long"]), "s string", "append", "NoTimeout")
