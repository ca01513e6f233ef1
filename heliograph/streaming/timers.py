"""Streams whose state ends by event time: rows wait until the watermark passes them, episodes end when it passes their gap."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import kalman_step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timer_state(spark: SparkSession):
    """While a stream with timers is started: state is kept by RocksDB, which they need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Episodes(StatefulProcessor):
    """Folds a key's rows, in order of event time, into episodes; see episode_stream."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, n long, total double")
        self.waiting = handle.getListState("waiting", "at long, v double")
        self.due = handle.getValueState("due", "at long")

    def _wait_for(self, at: int | None) -> None:
        """One timer a key: at the first event time at which there is something to do."""
        old = self.due.get()[0] if self.due.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _next(self) -> int | None:
        times = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if self.open.exists():
            times.append(self.open.get()[1] + self.gap)
        return min(times, default=None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for p in rows:  # a piece of the batch at a time, columns by place: with an initial state they come without names
            if p.empty:
                continue
            new = [(int(t), float(v)) for t, v in zip(p.iloc[:, 2], p.iloc[:, 3], strict=True) if t > passed]
            if new:
                self.waiting.appendList(new)
        self._wait_for(self._next())
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        self.due.clear()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        left = [r for r in rows if r[0] > passed]
        now = self.open.get() if self.open.exists() else None
        for at, v in rows[: len(rows) - len(left)]:
            if now and at - now[1] >= self.gap:
                out.append(now)
                now = None
            now = (now[0], max(now[1], at), now[2] + 1, now[3] + v) if now else (at, at, 1, v)
        if now and now[1] + self.gap <= passed and not (left and left[0][0] - now[1] < self.gap):
            out.append(now)
            now = None
        self.waiting.put(left) if left else self.waiting.clear()
        self.open.update(now) if now else self.open.clear()
        self._wait_for(self._next())
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=["_key", "start", "last", "n", "total"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for _, start, last, n, total in initialState.itertuples(index=False):
            self.open.update((int(start), int(last), int(n), float(total)))
        self._wait_for(self._next())

    def close(self) -> None:
        pass


def episode_stream(stream: DataFrame, key: str, ts: str, value: str, gap: str, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """key, start, last, n, total of a key's rows that follow each other within gap, given when the watermark has passed the
    gap: an episode ends without a further row of its key.

    Rows wait in state until the watermark, late behind the latest row seen, passes them, and are then taken in order, however
    batches were cut; rows behind it are dropped. initial (key, start, last, n, total) has episodes that are open when the
    stream first begins, one a key. Start the stream within timer_state(). Rows with a null key, time or value are left out.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    length = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {gap}) AS m").first()[0])
    kind = stream.schema[key].dataType.simpleString()
    d = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    d = d.withWatermark(ts, late).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), ms(ts).alias("_at"), F.col(value).cast("double").alias("_v"))
    first = None
    if initial is not None:
        first = initial.select(F.col(key).cast(kind).alias("_key"), ms("start").alias("start"), ms("last").alias("last"), F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total")).groupBy("_key")
    out = d.groupBy("_key").transformWithStateInPandas(statefulProcessor=Episodes(length), outputStructType=f"_key {kind}, start long, last long, n long, total double", outputMode="Append", timeMode="EventTime", initialState=first)
    at = lambda c: F.timestamp_millis(F.col(c)).alias(c)
    return out.select(F.col("_key").alias(key), at("start"), at("last"), "n", "total")


class InOrder(StatefulProcessor):
    """Folds a key's rows in order of event time, a piece of it at a time; see ordered_stream."""

    def __init__(self, width_ms: int, fold: Callable, begin, columns: list[str]) -> None:
        self.width, self.fold, self.begin, self.columns = width_ms, fold, begin, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "s string")
        self.waiting = handle.getMapState("waiting", "piece long", "rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, here = timerValues.getCurrentWatermarkInMs(), None
        for p in rows:  # _key, _ts, _us, values
            new: dict[int, list] = {}
            for us, *v in zip(*(p.iloc[:, i] for i in range(2, p.shape[1])), strict=True):
                if us // 1000 > passed:
                    new.setdefault(int(us) // 1000 // self.width, []).append([int(us), *(float(x) if x is not None else float("nan") for x in v)])
            if new and here is None:
                here = {k[0] for k in self.waiting.keys()}
                before = min(here, default=None)
            for piece, more in new.items():
                if piece in here:
                    more = json.loads(self.waiting.getValue((piece,))[0]) + more
                self.waiting.updateValue((piece,), (json.dumps(more),))
                here.add(piece)
        if here:
            self._wake(before, min(here))
        yield from ()

    def _wake(self, before: int | None, piece: int) -> None:
        """One timer a key: at the end of its first piece."""
        if before != piece:
            if before is not None:
                self.handle.deleteTimer((before + 1) * self.width)
            self.handle.registerTimer((piece + 1) * self.width)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // self.width
        here = sorted(k[0] for k in self.waiting.keys())
        state, done = json.loads(self.kept.get()[0]) if self.kept.exists() else self.begin, []
        for piece in here:
            if piece >= due:
                self._wake(None, piece)
                break
            rows = sorted(json.loads(self.waiting.getValue((piece,))[0]))
            state, out = self.fold(state, rows)
            self.waiting.removeKey((piece,))
            done += [(*key, r[0], *o) for r, o in zip(rows, out, strict=True)]
            if len(done) >= 5000:
                yield pd.DataFrame(done, columns=self.columns)
                done = []
        self.kept.update((json.dumps(state),))
        if done:
            yield pd.DataFrame(done, columns=self.columns)

    def close(self) -> None:
        pass


def ordered_stream(stream: DataFrame, key: str, ts: str, values: list[str], fold: Callable, begin, out: str, width: str = "1 HOUR", late: str = "10 minutes") -> DataFrame:
    """key, ts and the columns of out (as a schema) for each row, by fold(state, rows) -> (state, a tuple for each row), which
    sees a key's rows, [microseconds, values as floats], in order of time, then values, however batches were cut.

    Rows wait in state, by pieces of width, until the watermark, late behind the latest row seen, passes their piece. A piece
    of a key, not its whole micro-batch or backlog, is in memory at a time; rows behind the watermark are dropped. A state
    is what JSON holds, at first begin. A null value is NaN; rows with a null key or time are left out. Start the stream
    within timer_state().
    """
    length = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {width}) AS m").first()[0])
    kind = stream.schema[key].dataType.simpleString()
    d = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    d = d.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)])
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    got = d.groupBy("_key").transformWithStateInPandas(statefulProcessor=InOrder(length, fold, begin, ["_key", "_us", *names]), outputStructType=f"_key {kind}, _us long, {out}", outputMode="Append", timeMode="EventTime")
    return got.select(F.col("_key").alias(key), F.timestamp_micros("_us").alias(ts), *names)


def ordered_medians(stream: DataFrame, key: str, ts: str, value: str, n: int, **given) -> DataFrame:
    """key, ts, v, n: the median of the last n values at each row; rows without a value are left out."""

    def fold(last: list[float], rows: list) -> tuple[list[float], list[tuple]]:
        out = []
        for _, x in rows:
            last = [*last, x][-n:]
            out.append((float(np.median(last)), len(last)))
        return last, out

    return ordered_stream(stream.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), key, ts, [value], fold, [], "v double, n long", **given)


def ordered_kalman(stream: DataFrame, key: str, ts: str, u: str, z: str, x0=(3.0, -0.00053), p0=(1e-5, 1e-9), q: float = 1e-10, r: float = 10.0, **given) -> DataFrame:
    """key, ts, y: the filter of two states that kalman runs over tables; a row without z only predicts, one without u is
    left out."""

    def fold(s: list, rows: list) -> tuple[list, list[tuple]]:
        x, cov, last, out = np.array(s[0]), np.array(s[1]), s[2], []
        for _, a, b in rows:
            x, cov, last, y = kalman_step(x, cov, last, a, b, q, r)
            out.append((y,))
        return [x.tolist(), cov.tolist(), float(last)], out

    begin = [list(map(float, x0)), np.diag(p0).astype(float).tolist(), float("nan")]
    return ordered_stream(stream.where(F.col(u).isNotNull() & ~F.isnan(F.col(u).cast("double"))), key, ts, [u, z], fold, begin, "y double", **given)
