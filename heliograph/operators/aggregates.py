"""Aggregations: quantiles, metrics, histograms, information, marginals, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hazen_quantiles(df: DataFrame, key: list[str], value: str, ps: list[float]) -> DataFrame:
    """key, p, q: quantiles with breakpoints (i - 0.5) / n, clamped to the least and largest value; nulls and NaN are skipped.

    Equal values are counted before they are ranked. Ranks run within ranges of (key, value) and are carried across them, so
    a hot key is many tasks.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    v = v.repartitionByRange(*key, "v").withColumn("_r", F.spark_partition_id())
    along = W.partitionBy(*key)
    sums = v.groupBy("_r", *key).agg(F.sum("c").alias("s"))
    sums = sums.select("_r", *key, F.coalesce(F.sum("s").over(along.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("s").over(along).alias("n"))  # a row a range and key
    v = v.withColumn("own", F.sum("c").over(W.partitionBy("_r", *key).orderBy("v").rowsBetween(W.unboundedPreceding, 0))).alias("v")
    v = v.join(sums.alias("s"), [F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("_r", *key)]).select(*[F.col(f"v.{k}") for k in key], "v", "c", (F.col("own") + F.col("b")).alias("hi"), "n")
    v = v.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    pos = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("p") * F.col("n") + 0.5))
    lo, hi, first = F.floor(pos), F.ceil(pos), F.col("hi") - F.col("c") + 1
    has = lambda i: (first <= i) & (i <= F.col("hi"))
    a, b = F.max(F.when(has(lo), F.col("v"))), F.max(F.when(has(hi), F.col("v")))
    return v.withColumn("f", pos - lo).groupBy(*key, "p").agg((a + (b - a) * F.max("f")).alias("q"))


def present(c: Column) -> Column:
    """c with NaN as null, which aggregates skip."""
    return F.when(~F.isnan(c), c)


def complete(values: Column) -> Column:
    """True for arrays without a null or NaN."""
    return values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x))


def error_metrics(y: Column, f: Column) -> dict[str, Column]:
    """Aggregates of a forecast f of y; rows with a null in either are skipped."""
    ok = y.isNotNull() & f.isNotNull()
    y, f = F.when(ok, y), F.when(ok, f)
    e = f - y
    rmse = F.sqrt(F.avg(e * e))
    return {
        "n": F.count(e), "rmse": rmse, "rmse_percent": 100 * rmse / F.avg(y), "nrmse": rmse / (F.max(y) - F.min(y)), "mae": F.avg(F.abs(e)), "mbe": F.avg(e),
        "rrmse": rmse / F.stddev_pop(y), "r2": 1 - F.sum(e * e) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)), "r2_uncentred": 1 - F.sum(e * e) / F.sum(y * y),
    }


def paired(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, a, b of two series, in full: a side's missing rows are null, so that metrics can tell a length mismatch."""
    return a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key, "full")


def softmax_mean(value: Column, score: Column, k: float) -> Column:
    """Mean of value weighted by exp(-k score)."""
    w = F.exp(-k * score)
    return F.sum(w * value) / F.sum(w)


def histogram(df: DataFrame, key: list[str], value: str, bins: int) -> DataFrame:
    """key, bin, n over equal bins from the least to the largest value of each key; the largest is in the last bin."""
    ends = df.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = df.join(ends, key) if key else df.crossJoin(F.broadcast(ends))  # one row
    b = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1))
    return d.where(F.col(value).isNotNull()).groupBy(*key, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def marginals(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """axis, level, total: the sums along each axis, in one pass over grouping sets."""
    named = df.groupingSets([[F.col(a)] for a in axes], *[F.col(a) for a in axes]).agg(F.sum(value).alias("total"), *[F.grouping(a).alias(f"_{a}") for a in axes])
    pick = lambda of: F.coalesce(*[F.when(F.col(f"_{a}") == 0, of(a)) for a in axes])
    return named.select(pick(lambda a: F.lit(a)).alias("axis"), pick(lambda a: F.col(a).cast("string")).alias("level"), "total")


def information(df: DataFrame, x: str, y: str) -> DataFrame:
    """h_x, h_y, h_xy and mutual_information (nats) of two discrete columns, from their joint counts."""
    joint = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.partitionBy())
    entropy = lambda d: d.groupBy().agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h"))
    hx = entropy(joint.groupBy(x).agg(F.sum("c").alias("c"))).withColumnRenamed("h", "h_x")
    hy = entropy(joint.groupBy(y).agg(F.sum("c").alias("c"))).withColumnRenamed("h", "h_y")
    return hx.crossJoin(hy).crossJoin(entropy(joint).withColumnRenamed("h", "h_xy")).withColumn("mutual_information", F.col("h_x") + F.col("h_y") - F.col("h_xy"))  # one row each


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, tpr, fpr at each distinct threshold, from the highest; label is 0 or 1. Ranked are the distinct scores, whose
    running counts are taken within ranges and carried across them."""
    d = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(label).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n"))
    d = d.repartitionByRange(F.col("score").desc()).withColumn("_r", F.spark_partition_id())
    sums = d.groupBy("_r").agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    w, all_ = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = sums.select("_r", F.coalesce(F.sum("P").over(w), F.lit(0)).alias("p0"), F.coalesce(F.sum("N").over(w), F.lit(0)).alias("n0"), F.sum("P").over(all_).alias("pt"), F.sum("N").over(all_).alias("nt"))  # a row a range
    own = W.partitionBy("_r").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    d = d.select("score", "_r", F.sum("p").over(own).alias("p"), F.sum("n").over(own).alias("n")).join(F.broadcast(sums), "_r")
    return d.select("score", ((F.col("p") + F.col("p0")) / F.col("pt")).alias("tpr"), ((F.col("n") + F.col("n0")) / F.col("nt")).alias("fpr"))


def rare_classes_removed(df: DataFrame, label: str, least: int) -> DataFrame:
    """df without the classes of fewer than least rows, by a count per class rather than a window over rows."""
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(kept, label, "left_semi")


def quadrant_cover(pixels: DataFrame, frame: str, x: str, y: str, cloud: str, centre: tuple[float, float], sun: tuple[str, str] | None = None, radius: float | None = None) -> DataFrame:
    """frame, quadrant (TL, TR, BL, BR), cover: percent of cloud pixels around a centre, or within radius around the frame's sun."""
    cx, cy = (F.col(sun[0]), F.col(sun[1])) if sun else (F.lit(centre[0]), F.lit(centre[1]))
    dx, dy = F.col(x) - cx, F.col(y) - cy
    p = pixels if radius is None else pixels.where(dx * dx + dy * dy <= radius * radius)
    q = F.concat(F.when(dy < 0, "T").otherwise("B"), F.when(dx < 0, "L").otherwise("R"))
    return p.groupBy(frame, q.alias("quadrant")).agg((100 * F.avg(F.col(cloud).cast("double"))).alias("cover"))
