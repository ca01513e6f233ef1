"""Aligning differently sampled series. Time is a number (for example microseconds); key names the series' columns.

A series is cut into time buckets, so that one series of any length is many tasks; what is needed from other buckets (the
last sample before, the first after) comes from a table of one row per series and bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions import solar as S
from ..sources.logs import scratch
from .relations import lookup

DAY = 86_400_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _same(key: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key]


def running(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, bucket: int = 30 * DAY) -> DataFrame:
    """df with name: the sum of value over a series' rows up to each, in order, which begins with a number.

    Sums run within buckets of that number, and a table of one row per series and bucket carries them on. Null values add
    nothing; rows without the number come first.
    """
    d = df.withColumn("_v", value).withColumn("_k", F.floor(F.col(order[0]) / bucket))
    sums = d.groupBy(*key, "_k").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*key).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*key, "_k", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    own = F.sum("_v").over(W.partitionBy(*key, "_k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = d.withColumn("_o", F.coalesce(own, F.lit(0))).alias("d").join(sums.alias("s"), _same([*key, "_k"], "d", "s"))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("_o") + F.col("_c")).alias(name))


def beside(df: DataFrame, key: list[str], order: list[str], value: str, bucket: int = 30 * DAY) -> DataFrame:
    """df with _p and _n: the value of the rows just before and after each row of a series, in order, which begins with a
    number. Rows are ordered within buckets of that number, and a row per series and bucket gives the values beyond: one
    shuffle of the rows, where windowed takes two."""
    d = df.withColumn("_k", F.floor(F.col(order[0]) / bucket))
    v, at = F.struct(F.col(value).alias("v")), F.struct(*order)  # a struct tells a null value from no row
    across = W.partitionBy(*key).orderBy("_k")
    ends = d.groupBy(*key, "_k").agg(F.max_by(v, at).alias("_l"), F.min_by(v, at).alias("_f"))
    ends = ends.select(*key, "_k", F.lag("_l").over(across).alias("_lp"), F.lead("_f").over(across).alias("_fn"))
    own = W.partitionBy(*key, "_k").orderBy(*order)
    joined = d.withColumn("_p", F.lag(v).over(own)).withColumn("_n", F.lead(v).over(own)).alias("d").join(ends.alias("e"), _same([*key, "_k"], "d", "e"))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], F.coalesce("_p", "_lp")["v"].alias("_p"), F.coalesce("_n", "_fn")["v"].alias("_n"))


def windowed(df: DataFrame, key: list[str], order: list[str], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int = 1 << 16, **given) -> DataFrame:
    """df with columns(w), where w is the window of a series' rows in order and no column looks further than before rows
    back or after rows ahead; _i is a row's place in its series, from 1.

    A series is cut into ranges of size rows, each with copies of so many rows on either side of it: a hot series is many
    tasks of equal size.
    """
    if size < max(before, after):
        raise ValueError("a range is shorter than the window")
    at = F.col("_i") - 1
    here = F.floor(at / size)
    to = F.array_compact(F.array(here, F.when(at % size >= size - before, here + 1), F.when((at % size < after) & (here > 0), here - 1)))
    d = running(df, key, order, F.lit(1), "_i", **given).withColumn("_b", F.explode(to)).withColumn("_own", F.col("_b") == here)
    got = columns(W.partitionBy(*key, "_b").orderBy("_i"))
    return d.select("*", *[c.alias(k) for k, c in got.items()]).where("_own").select(*df.columns, *got)


def bracket(queries: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, bucket: int = DAY) -> DataFrame:
    """queries with before and after: structs (t, v) of the last sample at or before t and the first at or after it.

    Of samples at one time the largest value holds; samples without time or value are ignored, queries without time find
    nothing.
    """
    s = samples.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*key, F.col(t), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_s"))
    of = F.floor(F.col(t) / bucket).alias("_b")
    all_ = queries.withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType)).unionByName(s, allowMissingColumns=True).select("*", of)
    last = F.last("_s", ignorenulls=True)
    here = lambda order: last.over(W.partitionBy(*key, "_b").orderBy(order, F.col("_s").isNull(), "_s").rowsBetween(W.unboundedPreceding, 0))
    all_ = all_.withColumn("_p", here(F.col(t).asc())).withColumn("_n", here(F.col(t).desc()))
    ends = all_.groupBy(*key, "_b").agg(F.max("_s").alias("_l"), F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct(F.col("_s.t"), -F.col("_s.v").cast("double")))).alias("_f"))
    w = W.partitionBy(*key).orderBy("_b")
    ends = ends.select(*key, "_b", F.last("_l", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_cp"), F.first("_f", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_cn"))
    joined = all_.where("_s is null").alias("q").join(ends.alias("e"), _same([*key, "_b"], "q", "e"), "left")
    return joined.select(*[F.col(f"q.{c}") for c in queries.columns], F.coalesce("_p", "_cp").alias("before"), F.coalesce("_n", "_cn").alias("after"))


def nearest(queries: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, **given) -> DataFrame:
    """queries with t_near and v_near of the sample nearest in time; ties take the earlier."""
    b = bracket(queries, samples, key, t, value, **given)
    first = F.col("after").isNull() | (F.col(t) - F.col("before.t") <= F.col("after.t") - F.col(t))
    near = F.when(F.col("before").isNotNull() & first, F.col("before")).otherwise(F.col("after"))
    return b.select(*queries.columns, near["t"].alias("t_near"), near["v"].alias("v_near"))


def _line(t: Column) -> Column:
    b, a = F.col("before"), F.col("after")
    return F.when(a["t"] == b["t"], b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * (t - b["t"]) / (a["t"] - b["t"]))


def interpolate(queries: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, **given) -> DataFrame:
    """queries with v: the samples' line at t; null outside their range."""
    return bracket(queries, samples, key, t, value, **given).select(*queries.columns, _line(F.col(t)).alias("v"))


def extrapolate(queries: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, **given) -> DataFrame:
    """As interpolate, and the first and last segments go on outside the range; a lone sample gives null there."""
    at = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    s = samples.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    firsts = s.groupBy(*key, t).agg(F.max(value).alias(value)).groupBy(*key)
    # partial min/max by two keys: no ordering of the series
    one = firsts.agg(F.min(at).alias("f1"), F.max(at).alias("l1"))
    rest = s.join(one, key).groupBy(*key).agg(F.min(F.when(F.col(t) > F.col("f1.t"), at)).alias("f2"), F.max(F.when(F.col(t) < F.col("l1.t"), at)).alias("l2"))
    ends = one.join(rest, key)
    b = bracket(queries, samples, key, t, value, **given).join(ends, key, "left")
    ray = lambda p, q: F.col(p)["v"] + (F.col(q)["v"] - F.col(p)["v"]) * (F.col(t) - F.col(p)["t"]) / (F.col(q)["t"] - F.col(p)["t"])
    v = F.when(F.col("before").isNull(), ray("f1", "f2")).when(F.col("after").isNull(), ray("l2", "l1")).otherwise(_line(F.col(t)))
    return b.select(*queries.columns, v.alias("v"))


def ahead(queries: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, by: int, **given) -> DataFrame:
    """queries with v: the samples' line at t + by."""
    moved = queries.withColumn("_t", F.col(t)).withColumn(t, F.col(t) + by)
    return interpolate(moved, samples, key, t, value, **given).withColumn(t, F.col("_t")).drop("_t")


def resample(series: DataFrame, clock: DataFrame, key: list[str], t: str, value: str, **given) -> DataFrame:
    """The series (key, t, value) at the times of another clock (key, t): key, t, v, once for each time; null outside its range."""
    return interpolate(clock.select(*key, t).distinct(), series, key, t, value, **given)


def ewma(df: DataFrame, key: list[str], order: list[str], value: str, share: float, start: float, bucket: int = 30 * DAY) -> DataFrame:
    """df with v: (1 - share) of the row before's v (at first: start) and share of value; a null or NaN value leaves v as it
    is. Share is above 0 and 1 at most; order begins with a number.

    v is a sum of the values, each weighted by a power of 1 - share. The powers count within pieces of a bucket of that
    number, of as many values as leave 1e-249 of what was before, so that they stay within a double's range; the pieces' ends,
    a row each, are summed up by the same rule in blocks, of which only the last two have a digit left.
    """
    from math import log

    x = F.col(value).cast("double")
    some, decay = x.isNotNull() & ~F.isnan(x), -log(max(1 - share, 1e-249))
    size = max(1, int(573 / decay))

    def faded(d: DataFrame, w: list[str], by: list[str], add: Column, at: Column) -> Column:
        """The sum of add over w's rows up to each, which fade as at, from 0 to size within w, goes on."""
        total = F.sum(add * F.exp(decay * (at - size))).over(W.partitionBy(*w).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
        return F.coalesce(total, F.lit(0.0)) * F.exp(-decay * (at - size))

    d = df.withColumn("_k", F.floor(F.col(order[0]) / bucket))
    d = d.withColumn("_n", F.count(F.when(some, 1)).over(W.partitionBy(*key, "_k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_b", F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / size))).withColumn("_at", F.col("_n") - F.col("_b") * size)
    d = d.withColumn("_own", faded(d, [*key, "_k", "_b"], order, F.when(some, share * x), F.col("_at")))
    e = d.groupBy(*key, "_k", "_b").agg(F.max_by(F.struct("_own", "_at"), F.struct(*order)).alias("e")).select(*key, "_k", "_b", "e.*")
    along = W.partitionBy(*key).orderBy("_k", "_b")
    e = e.withColumn("_n", F.sum("_at").over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("_c", F.floor(F.col("_n") / size))
    e = e.withColumn("_s", faded(e, [*key, "_c"], ["_k", "_b"], F.col("_own"), F.col("_n") - F.col("_c") * size))
    last = e.groupBy(*key, "_c").agg(F.max_by(F.struct("_s", "_n"), F.struct("_k", "_b")).alias("_l")).select(*key, (F.col("_c") + 1).alias("_c"), "_l")
    e = e.alias("e").join(last.alias("l"), _same([*key, "_c"], "e", "l"), "left").select(*[F.col(f"e.{c}") for c in e.columns], "_l")
    older = F.coalesce(F.col("_l")["_s"] * F.exp(-decay * (F.col("_n") - F.col("_l")["_n"])), F.lit(0.0))
    v = F.col("_s") + older + start * F.exp(-decay * F.col("_n"))
    e = e.withColumn("_v", v).select(*key, "_k", "_b", F.coalesce(F.lag("_v").over(along), F.lit(float(start))).alias("_start"))
    joined = d.alias("d").join(e.alias("e"), _same([*key, "_k", "_b"], "d", "e"))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("_own") + F.exp(-decay * F.col("_at")) * F.col("_start")).alias("v"))


def regular_suffix(df: DataFrame, key: list[str], t: str, step: float, noise: float, **given) -> DataFrame:
    """The rows of each series from the last gap on that differs from step by more than noise."""
    d = windowed(df.select(*key, t), key, [t], 1, 0, lambda w: {"_g": F.col(t) - F.lag(t).over(w)}, **given)
    cut = d.groupBy(*key).agg(F.max(F.when(F.abs(F.col("_g") - step) > noise, F.col(t))).alias("_c"))
    return df.join(cut, key).where(F.col("_c").isNull() | (F.col(t) >= F.col("_c"))).select(*df.columns)


def minute_mean(df: DataFrame, key: list[str], ts: str, value: str, how=F.avg) -> DataFrame:
    """key, minute, v: an aggregate per whole minute."""
    return df.groupBy(*key, F.date_trunc("minute", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("minute")).agg(how(value).alias("v"))


def despike(df: DataFrame, key: list[str], order: list[str], value: str, passes: int = 3, sigmas: float = 6.0, **given) -> DataFrame:
    """df without spikes: rows further from the median of themselves and both neighbours than the mean of that distance
    plus sigmas of its standard deviations; repeated passes. The first and the last row of a series stay.

    Each pass writes its distances, as both their statistics and the rows are read from them.
    """

    p, n, v = F.col("_p"), F.col("_n"), F.col(value)
    distance = F.when(p.isNotNull() & n.isNotNull(), F.abs(p + n + v - F.greatest(p, n, v) - F.least(p, n, v) - v))
    spark, names = df.sparkSession, df.columns
    for _ in range(passes):
        path = scratch(spark, "despike")
        beside(df, key, order, value, **given).withColumn("_d", distance).drop("_p", "_n").write.parquet(path)
        d = spark.read.parquet(path)
        limit = d.groupBy(*key).agg((F.avg("_d") + sigmas * F.stddev_samp("_d")).alias("_m"))
        joined = d.alias("d").join(limit.alias("l"), _same(key, "d", "l"))
        df = joined.where(F.coalesce(F.col("_d") <= F.col("_m"), F.lit(True))).select(*[F.col(f"d.{c}") for c in names])
    return df


def clear_sky_test(df: DataFrame, key: list[str], t: str, value: str, reference: str, *, window: int, k: int, threshold: float, max_deviation: float = 0.12, low: float = 80.0) -> DataFrame:
    """df with statistic and is_clear: over the window before a row, the k largest deviations from the reference less the
    k smallest. Fewer than 2k rows count as clear; a row far from its reference (over low) never does.

    A series is cut into buckets of time no shorter than the window, each with copies of the rows just before it.
    """
    width = max(DAY, window)
    here = F.floor(F.col(t) / width)
    to = F.when(here.isNull(), F.array(here)).otherwise(F.array_compact(F.array(here, F.when(F.col(t) - here * width > width - window, here + 1))))
    w = W.partitionBy(*key, "_b").orderBy(t).rangeBetween(-(window - 1), 0)
    kept = F.sort_array(F.collect_list(F.col(value) - F.col(reference)).over(w))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    far = (F.col(reference) > low) & (F.abs(F.col(reference) - F.col(value)) / F.col(reference) > max_deviation)
    d = df.withColumn("_b", F.explode(to)).withColumn("_own", F.col("_b").eqNullSafe(here)).withColumn("_k", kept).where("_own")
    statistic = F.when(F.size("_k") >= 2 * k, total(F.slice("_k", F.size("_k") - k + 1, F.lit(k))) - total(F.slice("_k", 1, k)))
    return d.withColumn("statistic", statistic).withColumn("is_clear", ~F.coalesce(far, F.lit(False)) & F.coalesce(F.col("statistic") < threshold, F.lit(True))).drop("_k", "_b", "_own")


def running_median(df: DataFrame, key: list[str], order: list[str], value: str, where: Column, n: int = 9, least: int = 3, seed: float | None = None, **given) -> DataFrame:
    """Rows that meet where, with v: the median of the last n of them, from least of them on. A seed counts as one value
    before the first and stays until it is pushed out."""

    def median(w: WindowSpec) -> dict[str, Column]:
        got = F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))
        return {"_g": got if seed is None else F.when(F.col("_i") < n, F.array_append(got, F.lit(float(seed)))).otherwise(got)}

    s, m = F.sort_array(F.col("_g")), F.size("_g")
    mid = (F.element_at(s, F.floor((m + 1) / 2).cast("int")) + F.element_at(s, F.floor(m / 2).cast("int") + 1)) / 2
    return windowed(df.where(where), key, order, n - 1, 0, median, **given).withColumn("v", F.when(m >= least, mid)).drop("_g")


def kalman(df: DataFrame, key: list[str], t: str, u: str, z: str, *, x0=(3.0, -0.00053), p0=(1e-5, 1e-9), q: float = 1e-10, r: float = 10.0) -> DataFrame:
    """key, t, y: a filtered quadratic response y = a u + b u^2, its state updated by each measured z; a null z predicts only.

    Feedback from row to row makes each series a sequence in one task; it is sorted by Spark and read in batches, and only
    the state, two vectors, goes from one to the next.
    """
    import numpy as np

    from ..streaming.stateful import kalman_step

    names = [*key, t]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        last_key = x = cov = last = None
        for p in batches:
            p, out = p.astype({u: float, z: float}), []
            keys = p[key].astype(object).where(p[key].notna(), None).itertuples(index=False, name=None)
            for k, a, b in zip(keys, p[u].to_numpy(), p[z].to_numpy(), strict=True):
                if k != last_key:
                    last_key, x, cov, last = k, np.array(x0, float), np.diag(p0).astype(float), float("nan")
                x, cov, last, y = kalman_step(x, cov, last, a, b, q, r)
                out.append(y)
            yield p[names].assign(y=out)

    d = df.select(*key, t, u, z).repartition(*key).sortWithinPartitions(*key, t, u)
    return d.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "y double"]))


def lagged(df: DataFrame, key: list[str], order: list[str], values: list[str], lags: list[int], **given) -> DataFrame:
    """df with value_lag columns, the rows before a series' row: the inputs of an autoregressive model."""
    return windowed(df, key, order, max(lags), 0, lambda w: {f"{v}_{i}": F.lag(v, i).over(w) for v in values for i in lags}, **given)


def dirint(df: DataFrame, key: list[str], order: list[str], ghi: str, zenith: str, doy: str, coefficients: DataFrame, pressure: float = 101325.0, dew_point: str | None = None, **given) -> DataFrame:
    """df with dni (in place of a column of that name): DISC's beam corrected by a coefficient of the clearness, the zenith, the change of clearness to the rows
    beside and the water in the air.

    coefficients: kt, z, change, water (classes from 1) and coefficient, the published table of 6 x 6 x 7 x 5 rows; change
    7: a series of one row, water 5: no dew point. Rows of no class have 0.
    """
    prime = S.clearness_prime(F.col(ghi), F.col(zenith), F.col(doy), pressure)
    d = windowed(df.withColumn("_kt", prime), key, order, 1, 1, lambda w: {"_p": F.lag("_kt").over(w), "_n": F.lead("_kt").over(w)}, **given)
    p, n = F.coalesce("_p", "_n"), F.coalesce("_n", "_p")
    change = F.coalesce(S.class_of(0.5 * (F.abs(F.col("_kt") - n) + F.abs(F.col("_kt") - p)), S.DIRINT_CHANGE), F.lit(7))
    water = F.lit(5) if dew_point is None else F.coalesce(S.class_of(F.exp(0.07 * F.col(dew_point) - 0.075), S.DIRINT_WATER), F.lit(5))
    at = {"_c1": S.class_of(F.col("_kt"), S.DIRINT_KT), "_c2": S.class_of(F.col(zenith).cast("double"), S.DIRINT_ZENITH), "_c3": change, "_c4": water}
    table = coefficients.select(F.col("kt").alias("_c1"), F.col("z").alias("_c2"), F.col("change").alias("_c3"), F.col("water").alias("_c4"), F.col("coefficient").alias("_c"))
    d = lookup(d.withColumns(at), table, list(at))
    return d.select(*[c for c in df.columns if c != "dni"], (S.disc_dni(F.col(ghi), F.col(zenith), F.col(doy), pressure) * F.coalesce("_c", F.lit(0.0))).alias("dni"))
