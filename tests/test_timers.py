"""Streams with timers, an initial state and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from heliograph.streaming import stateful, timers

SCHEMA = "k string, ts timestamp, v double"
T0 = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, transform, batches, mode="append", timers_=False):
    """The rows that a stream gives after each batch has arrived, one file a batch."""
    schema, seen = SCHEMA, []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        w = s.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True)
        if timers_:
            with timers.timer_state(spark):
                w.start().awaitTermination()
        else:
            w.start().awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()))
    return seen


def test_an_episode_ends_without_a_further_row_and_starts_from_what_was_open(spark, tmp_path):
    initial = spark.createDataFrame([("a", at(-5), at(-2), 4, 10.0), ("c", at(-50), at(-40), 2, 1.0)], "k string, start timestamp, last timestamp, n long, total double")
    make = lambda s: timers.episode_stream(s, "k", "ts", "v", "10 MINUTES", "2 minutes", initial)
    seen = run(spark, tmp_path, make, [
        [("a", at(3), 1.0), ("a", at(1), 2.0), ("b", at(2), 5.0), (None, at(2), 1.0), ("b", None, 1.0)],
        [("b", at(30), 7.0)],  # its watermark is 28: a and the first of b have ended, with no row of a
        [("b", at(29), 1.0), ("b", at(20), 100.0), ("b", at(33), 1.0)],  # 20 is late
        [("z", at(90), 0.0)],
    ], timers_=True)
    assert ("a", at(-5), at(3), 6, 13.0) in seen[1] and ("b", at(2), at(2), 1, 5.0) in seen[1]
    assert ("c", at(-50), at(-40), 2, 1.0) in seen[1]
    assert [r for r in seen[3] if r not in seen[1]] == [("b", at(29), at(33), 3, 9.0)]


def test_minutes_in_append_mode_drop_late_rows(spark, tmp_path):
    seen = run(spark, tmp_path, lambda s: stateful.minute_stream(s, ["k"], "ts", "v", "2 minutes"), [
        [("a", at(0), 1.0), ("a", at(0.5), 3.0)],
        [("a", at(10), 5.0)],
        [("a", at(0.7), 99.0), ("a", at(9), 2.0)],  # the first is behind the watermark, 8
        [("a", at(30), 0.0)],
        [("a", at(60), 0.0)],
    ])
    got = sorted((r[1], r[2], r[3]) for r in seen[-1])
    assert got[:3] == [(at(0), 2.0, 2), (at(9), 2.0, 1), (at(10), 5.0, 1)]


def test_sessions_and_sliding_windows_in_append_mode(spark, tmp_path):
    rows = [[("a", at(m), 1.0) for m in (0, 2, 20)], [("a", at(60), 1.0)], [("a", at(1), 9.0)], [("a", at(120), 1.0)], [("a", at(240), 1.0)]]
    s = run(spark, tmp_path / "s", lambda d: stateful.session_stream(d, ["k"], "ts", "v", "5 minutes", "5 minutes"), rows)[-1]
    assert [(r[1], r[2], r[3]) for r in s][:3] == [(at(0), 2, 2.0), (at(20), 1, 1.0), (at(60), 1, 1.0)]
    w = run(spark, tmp_path / "w", lambda d: stateful.sliding_stream(d, ["k"], "ts", "v", "10 minutes", "5 minutes", "5 minutes"), rows)[-1]
    assert {(r[1], r[3]) for r in w} >= {(at(-5), 2), (at(0), 2), (at(15), 1), (at(20), 1)} and not any(r[2] > 1 for r in w)


def test_batches_of_any_size_give_the_same(spark, tmp_path):
    import numpy as np

    g = np.random.default_rng(1)
    times = np.cumsum(g.integers(1, 14, 60))
    rows = [("ab"[i % 2], at(int(t)), float(i)) for i, t in enumerate(times)]
    end = [("z", at(5000), 0.0)]
    make = lambda s: timers.episode_stream(s, "k", "ts", "v", "15 MINUTES", "60 minutes")
    one = run(spark, tmp_path / "one", make, [rows, end, [("z", at(9000), 0.0)]], timers_=True)[-1]
    few = [rows[i : i + 20] for i in range(0, 60, 20)]
    many = run(spark, tmp_path / "many", make, [list(reversed(b)) for b in few] + [end, [("z", at(9000), 0.0)]], timers_=True)[-1]
    assert one == many and len(one) > 4 and sum(r[3] for r in one if r[0] in "ab") == 60


def test_rows_are_folded_in_order_however_batches_were_cut(spark, tmp_path):
    import numpy as np

    g = np.random.default_rng(2)
    times = np.cumsum(g.integers(1, 9, 80))
    rows = [("ab"[i % 2], at(int(t)), float(g.normal()) if i % 9 else None) for i, t in enumerate(times)]
    rows += [("a", at(int(times[3])), -50.0), (None, at(3), 1.0), ("b", None, 1.0)]
    end = [[("z", at(5000), 0.0)], [("z", at(9000), 0.0)]]
    make = lambda s: timers.ordered_medians(s, "k", "ts", "v", 5, width="25 MINUTES", late="1000 minutes")
    one = run(spark, tmp_path / "one", make, [rows, *end], timers_=True)[-1]
    few = [list(reversed(rows[i : i + 30])) for i in range(0, 90, 30)]
    late = [("a", at(1), 1000.0)]
    many = run(spark, tmp_path / "many", make, [rows[60:], few[1], few[0], end[0], late, end[1]], timers_=True)[-1]
    assert one == many
    want = []
    for k in "ab":
        last = []
        for _, t, v in sorted(r for r in rows if r[0] == k and r[1] is not None and r[2] is not None):
            last = [*last, v][-5:]
            want.append((k, t, float(np.median(last)), len(last)))
    assert [r for r in one if r[0] != "z"] == sorted(want)


def test_the_filter_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    import numpy as np

    x, cov, last, want = np.array([3.0, -0.00053]), np.diag([1e-5, 1e-9]), float("nan"), []
    rows = [("a", at(3 * i), float(20 + 10 * np.sin(i)) if i % 5 else None) for i in range(40)]
    for _, t, v in rows:
        u = (t - T0).seconds / 600.0 + 1
        x, cov, last, y = stateful.kalman_step(x, cov, last, u, float("nan") if v is None else v, 1e-10, 10.0)
        want.append((t, y))
    level = F.unix_timestamp("ts") - F.lit(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))
    make = lambda s: timers.ordered_kalman(s.withColumn("u", F.when(F.col("k") == "a", level / 600.0 + 1).otherwise(1.0)), "k", "ts", "u", "v", width="10 MINUTES")
    got = run(spark, tmp_path, make, [rows[20:10:-1] + rows[:11], rows[21:], [("z", at(900), 0.0)], [("z", at(5000), 0.0)]], timers_=True)[-1]
    got = [(r[1], r[2]) for r in got if r[0] == "a"]
    assert [t for t, _ in got] == [t for t, _ in want] and np.allclose([y for _, y in got], [y for _, y in want])


def test_a_key_has_one_timer_however_many_pieces_wait():
    """Calls to the state store are what such a stream costs."""
    import pandas as pd

    class Values(dict):
        def containsKey(self, k):
            return k in self

        def removeKey(self, k):
            del self[k]

        exists, get, update = (lambda self: () in self), (lambda self: self[()]), (lambda self, v: self.__setitem__((), v))
        updateValue, getValue = dict.__setitem__, dict.__getitem__

    class Handle:
        def __init__(self):
            self.timers, self.calls = [], 0

        getValueState = getMapState = lambda self, *_: Values()

        def registerTimer(self, t):
            self.calls += 1
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    h, p = Handle(), timers.InOrder(10, lambda s, rows: (s + len(rows), [(s + i,) for i in range(len(rows))]), 0, ["_key", "_us", "n"])
    p.init(h)
    rows = pd.DataFrame([(1, None, us * 1000, 0.5) for us in (95, 5, 33, 31, 58)])
    assert not list(p.handleInputRows((1,), iter([rows]), Now(0))) and h.timers == [10] and h.calls == 1
    h.timers.clear()
    got = pd.concat(p.handleExpiredTimer((1,), Now(60), Now(10)))
    assert got["_us"].tolist() == [5000, 31000, 33000, 58000] and got["n"].tolist() == [0, 1, 2, 3] and h.timers == [100]
    assert not list(p.handleInputRows((1,), iter([rows[:1].assign(**{})]), Now(60))) and h.timers == [100]
