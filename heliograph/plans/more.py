"""Further queries: filters, order, images, learning; sources and sinks as round trips; streams that resume."""

from __future__ import annotations

import os
from contextlib import nullcontext

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric as N
from ..functions import solar as S
from ..operators import aggregates as A
from ..operators import fields as I
from ..operators import frames as V
from ..operators import learning as L
from ..operators import machines as M
from ..operators import networks as N5
from ..operators import relations as R
from ..operators import series as T
from ..operators import splines as P
from ..operators import trees as R5
from ..sources import database, logs, matfiles
from ..streaming import stateful, timers
from .queries import BRACKET, COS, DISC, FIELD, ORACLE_SQL, OVER, PLACE, QUERIES, REACH, SAMPLES, SIDE, SIN, E, events, field, query, r, samples, table

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- filters --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0.02")
def f4_complete_rows(spark, sf_dir):
    nan = lambda c, at: F.when(F.col(c) == at, float("nan")).otherwise(F.col(c))
    values = F.array(F.col("l_quantity"), nan("l_discount", 0), nan("l_tax", 0.02))
    return table(spark, sf_dir, "lineitem").where(A.complete(values)).select("l_orderkey", "l_linenumber")


@query(f"WITH {SAMPLES} SELECT l_orderkey, l_linenumber, round(100 * (ghi - clear) / ghi, 6) + 0.0 AS error FROM s WHERE abs(100 * (ghi - clear) / ghi) < 160 AND clear / 1000 > 0.25 AND day NOT IN ('1995-06-17', '1996-01-02')")
def f5_bounded_error(spark, sf_dir):
    e = 100 * (F.col("ghi") - F.col("clear")) / F.col("ghi")
    s = logs.days(samples(spark, sf_dir), skip=("1995-06-17", "1996-01-02"))
    return s.where((F.abs(e) < 160) & (F.col("clear") / 1000 > 0.25)).select("l_orderkey", "l_linenumber", r(e).alias("error"))


_RGB = "r AS (SELECT *, value AS red, (value * 7 + x) % 256 AS green, (value * 5 + y) % 256 AS blue, (x - 12) * (x - 12) + (y - 12) * (y - 12) <= 25 AS near_sun FROM f)"


@query(f"WITH {FIELD}, {_RGB} SELECT frame, x, y FROM r WHERE CASE WHEN near_sun THEN green / nullif(blue, 0) > 0.96 ELSE red / nullif(blue, 0) > 0.92 AND red + green + blue > 250 END")
def f14_cloud_pixels(spark, sf_dir):
    v, x, y = F.col("value"), F.col("x"), F.col("y")
    sun = (x - 12) * (x - 12) + (y - 12) * (y - 12) <= 25
    return field(spark, sf_dir).where(I.cloud_mask(v, (v * 7 + x) % 256, (v * 5 + y) % 256, sun)).select("frame", "x", "y")


_AREAS = f"WITH RECURSIVE {FIELD}, p AS (SELECT frame, x, y FROM f WHERE value > 200), {REACH} SELECT frame, id // {SIDE} AS first_x, id % {SIDE} AS first_y, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy FROM g GROUP BY frame, id"


def _areas(spark, sf_dir, *limits) -> DataFrame:
    a = I.areas(I.components(field(spark, sf_dir).where("value > 200").select("frame", "x", "y"), "frame"), "frame", *limits)
    return a.select("frame", F.col("component.x").alias("first_x"), F.col("component.y").alias("first_y"), "n", "x0", "x1", "y0", "y1", r(F.col("cx")).alias("cx"), r(F.col("cy")).alias("cy"))


@query(_AREAS)
def i14_components(spark, sf_dir):
    return _areas(spark, sf_dir)


@query(f"SELECT * FROM ({_AREAS}) WHERE n BETWEEN 3 AND 60")
def f15_area_filter(spark, sf_dir):
    return _areas(spark, sf_dir, 3, 60)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 100000")
def f16_quoted_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("%% Priority"), F.col("o_totalprice").alias("Total `%` price"))
    return o.where(F.col("`%% Priority`").isin("1-URGENT", "5-LOW") & (F.col("`Total ``%`` price`") >= 100000)).select("o_orderkey")


# ---- joins, aggregates, order ----------------------------------------------------------------------


@query(f"WITH {BRACKET.replace('click', 'purchase').replace('SELECT event_id, user_id, t FROM', 'SELECT DISTINCT user_id, t FROM')} SELECT user_id, t, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) + 0.0 AS v FROM x")
def j6_resample(spark, sf_dir):
    e = lambda k: events(spark, sf_dir, k)
    return T.resample(e("view").select("user_id", "t", "value"), e("purchase"), ["user_id"], "t", "value").select("user_id", "t", r(F.col("v")).alias("v"))


@query()
def j14_assignment(spark, sf_dir):
    """Of an order's lines and the quantities wanted, 10 apart, the pairs of least total difference."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity")
    pairs = n.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("cost", F.abs(F.col("l_quantity") - 10 * F.col("slot") - 5))
    return R.assigned(pairs, "l_orderkey", "line", "slot", "cost", alone=20.0)


_DP = lambda i: f"d{i + 1} AS (SELECT l_orderkey, mask, min(cost) AS cost FROM (SELECT d.l_orderkey, mask, cost + CASE WHEN q IS NULL THEN 0 ELSE 20 END AS cost FROM d{i} d LEFT JOIN n ON n.l_orderkey = d.l_orderkey AND i = {i + 1} UNION ALL SELECT d.l_orderkey, mask + (1 << slot), cost + abs(q - 10 * slot - 5) FROM d{i} d JOIN n ON n.l_orderkey = d.l_orderkey AND i = {i + 1}, (SELECT unnest(range(5))::INTEGER AS slot) WHERE mask & (1 << slot) = 0) GROUP BY ALL)"


@query(f"WITH n AS (SELECT l_orderkey, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem)), d0 AS (SELECT DISTINCT l_orderkey, 0 AS mask, 0.0::DOUBLE AS cost FROM n), {', '.join(map(_DP, range(8)))} SELECT l_orderkey, round(min(cost + 20 * (5 - bit_count(mask))), 4) + 0.0 AS cost FROM d8 GROUP BY l_orderkey")
def j14_assignment_cost(spark, sf_dir):
    """The least total difference of an order's assignment, each line or quantity left alone at 20; the SQL goes through all
    subsets of quantities, line by line."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.max("l_quantity").cast("double").alias("q"))
    pairs = n.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("cost", F.abs(F.col("q") - 10 * F.col("slot") - 5))
    taken = R.assigned(pairs, "l_orderkey", "line", "slot", "cost", alone=20.0).join(pairs, ["l_orderkey", "line", "slot"]).groupBy("l_orderkey").agg(F.sum("cost").alias("c"), F.count(F.lit(1)).alias("k"))
    lines = n.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    alone = 20.0 * (F.col("n") + 5 - 2 * F.coalesce("k", F.lit(0)))
    return lines.join(taken, "l_orderkey", "left").select("l_orderkey", r(F.coalesce("c", F.lit(0.0)) + alone, 4).alias("cost"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_discount) FILTER (l_discount <> 0.05) AS total, round(avg(l_discount) FILTER (l_discount <> 0.05), 9) + 0.0 AS mean, round(var_samp(l_discount) FILTER (l_discount <> 0.05), 9) + 0.0 AS variance FROM lineitem GROUP BY ALL".replace("sum(l_discount) FILTER (l_discount <> 0.05)", "round(sum(l_discount) FILTER (l_discount <> 0.05), 4) + 0.0"))
def a4_without_nan(spark, sf_dir):
    v = A.present(F.when(F.col("l_discount") == 0.05, float("nan")).otherwise(F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum(v), 4).alias("total"), r(F.avg(v), 9).alias("mean"), r(F.var_samp(v), 9).alias("variance"))


@query(f"WITH {FIELD} SELECT frame, y, max(value) AS top FROM f GROUP BY ALL")
def a14_row_maximum(spark, sf_dir):
    return field(spark, sf_dir).groupBy("frame", "y").agg(F.max("value").alias("top"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def t1_full_sort(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(F.desc("o_totalprice"), "o_orderkey").withColumn("_r", F.spark_partition_id())
    sizes = o.groupBy("_r").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.select("_r", F.coalesce(F.sum("c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row a range
    place = F.row_number().over(W.partitionBy("_r").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("i", place).join(F.broadcast(sizes), "_r").select("o_orderkey", (F.col("i") + F.col("b")).alias("place"))


@query("SELECT o_orderkey, ntile(4) OVER w AS quarter, dense_rank() OVER w AS rank, round(percent_rank() OVER w, 9) + 0.0 AS share, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def w18_ranks(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.dense_rank().over(w).cast("long").alias("rank"), r(F.percent_rank().over(w), 9).alias("share"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@query(f"WITH {E}, k AS (SELECT event_id, list_prepend(50.0::DOUBLE, list(value) {OVER('ROWS UNBOUNDED PRECEDING')}) AS k FROM e) SELECT event_id, round(list_reduce(k, lambda v, x: (1 - 0.1371::DOUBLE) * v + 0.1371::DOUBLE * x), 6) + 0.0 AS v FROM k")
def w14_smoothing(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "t", "value")
    return T.ewma(e, ["user_id"], ["t", "event_id"], "value", 0.1371, 50.0).select("event_id", r(F.col("v")).alias("v"))


@query(f"WITH {E}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e), c AS (SELECT user_id, max(t) FILTER (abs(g - 43200000000) > 86400000000) AS c FROM g GROUP BY ALL) SELECT event_id FROM e JOIN c USING (user_id) WHERE c IS NULL OR t >= c")
def w17_regular_suffix(spark, sf_dir):
    return T.regular_suffix(events(spark, sf_dir), ["user_id"], "t", 43_200_000_000, 86_400_000_000).select("event_id")


# ---- images ----------------------------------------------------------------------------------------


@query(f"WITH {FIELD}, k AS (SELECT *, x - 12 + 0.5::DOUBLE AS u, y - 12 + 0.5::DOUBLE AS v, (value - 100)::DOUBLE AS w FROM f) SELECT frame, x, y, CASE WHEN w > 0 THEN round(300 / w * u, 6) + 0.0 END AS px, CASE WHEN w > 0 THEN round(300 / w * v, 6) + 0.0 END AS py FROM k")
def i2_plane_projection(spark, sf_dir):
    ray = (F.col("x") - 12 + 0.5, F.col("y") - 12 + 0.5, (F.col("value") - 100).cast("double"))
    return field(spark, sf_dir).select("frame", "x", "y", *[r(c).alias(n) for c, n in zip(N.on_plane(ray, 300.0), ("px", "py"), strict=True)])


@query("""WITH d AS (SELECT l_partkey % 50 AS pixel, l_suppkey % 7 AS shade, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i, l_quantity::DOUBLE AS x, (l_extendedprice / 100)::DOUBLE AS y FROM lineitem),
s AS (SELECT a.pixel, a.shade, a.i, a.x, a.y, (b.y - a.y) / (b.x - a.x) AS m, sum(abs(b.x - a.x)) AS w FROM d a JOIN d b ON a.pixel = b.pixel AND a.shade = b.shade AND b.x <> a.x GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY i ORDER BY m) AS upto, sum(w) OVER (PARTITION BY i) AS whole FROM s),
l AS (SELECT pixel, shade, i, x, y, min(m) AS m FROM c WHERE 2 * upto >= whole GROUP BY ALL UNION ALL SELECT pixel, shade, i, x, y, 0 FROM d),
e AS (SELECT l.pixel, l.shade, l.i, l.m, sum(abs(d.y - l.y - l.m * (d.x - l.x))) AS error FROM l JOIN d ON l.pixel = d.pixel AND l.shade = d.shade GROUP BY ALL)
SELECT pixel, shade, round(min(error), 4) + 0.0 AS error FROM e GROUP BY ALL""")
def i8_absolute_lines(spark, sf_dir):
    """The least-error lines of all samples of each pixel; the SQL tries every sample as a pivot, whose best slope is a
    weighted median."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("pixel"), (F.col("l_suppkey") % 7).alias("shade"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y"))
    return L.absolute_line(d, ["pixel", "shade"], "x", "y").select("pixel", "shade", r(F.col("error"), 4).alias("error"))


@query(f"""WITH RECURSIVE {FIELD}, h AS (SELECT frame, value // 8 AS l, count(*) AS c FROM f GROUP BY ALL), w AS (SELECT *, lag(c) OVER o AS p, lead(c) OVER o AS q, lag(l) OVER o AS pl, lead(l) OVER o AS ql FROM h WINDOW o AS (PARTITION BY frame ORDER BY l)),
s AS (SELECT frame, l, CASE WHEN coalesce(p < c, false) AND NOT coalesce(q < c, false) THEN -1 WHEN coalesce(q < c, false) THEN 1 ELSE 0 END AS side FROM w WHERE l = 16),
g AS (SELECT * FROM s UNION SELECT g.frame, CASE g.side WHEN -1 THEN w.pl ELSE w.ql END, g.side FROM g JOIN w ON g.frame = w.frame AND g.l = w.l WHERE g.side = -1 AND w.p < w.c OR g.side = 1 AND w.q < w.c)
SELECT frame, CASE WHEN min(side) = -1 THEN min(l) ELSE max(l) END::DOUBLE AS minimum FROM g GROUP BY frame""")
def i9_local_minimum(spark, sf_dir):
    h = field(spark, sf_dir).groupBy("frame", F.floor(F.col("value") / 8).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return I.local_minimum(h, "frame", "l", "n", h.where("l = 16").select("frame", F.col("l").cast("double").alias("threshold")))


_RADII, _ANGLES = [1.5, 4.0, 9.25, 13.0], [0.0, 0.7, 2.0, 3.5, 5.1]


@query(f"""WITH {FIELD}, k AS (SELECT DISTINCT frame FROM f), t AS (SELECT frame, a, r, 11.5::DOUBLE + cos(ang) * rad AS px, 12.25::DOUBLE + sin(ang) * rad AS py FROM k, (SELECT unnest(range({len(_ANGLES)})) AS a, unnest({_ANGLES}::DOUBLE[]) AS ang), (SELECT unnest(range({len(_RADII)})) AS r, unnest({_RADII}::DOUBLE[]) AS rad)),
c AS (SELECT *, unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j FROM t), w AS (SELECT *, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y, (CASE i WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE j WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) AS share FROM c)
SELECT w.frame, a, r, CASE WHEN count(f.value) = count(*) THEN round(sum(f.value * share), 6) + 0.0 END AS value FROM w LEFT JOIN f ON w.frame = f.frame AND w.x = f.x AND w.y = f.y WHERE share > 0 GROUP BY w.frame, a, r""")
def i15_polar(spark, sf_dir):
    return I.polar(field(spark, sf_dir), "frame", (11.5, 12.25), _ANGLES, _RADII).withColumn("value", r(F.col("value")))


@query(f"WITH {FIELD}, m AS (SELECT *, value > 128 AS inside FROM f) SELECT a.frame, a.x, a.y, round(CASE WHEN a.inside THEN 1 ELSE -1 END * sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) + 0.0 AS distance FROM m a LEFT JOIN m b ON a.frame = b.frame AND a.inside <> b.inside GROUP BY a.frame, a.x, a.y, a.inside")
def i7_signed_distance(spark, sf_dir):
    return I.signed_distance(field(spark, sf_dir), "frame", F.col("value") > 128).withColumn("distance", r(F.col("distance")))


@query(f"""WITH {FIELD}, k AS (SELECT frame, x, y, (x - 12)::DOUBLE AS u, (y - 12)::DOUBLE AS v, (value - 100) / 10.0::DOUBLE AS w FROM f), a AS (SELECT *, sqrt(u * u + v * v) AS n, atan2(w, sqrt(u * u + v * v)) AS t FROM k), b AS (SELECT *, 300.0::DOUBLE + 170 * t + 12 * t * t - 3 * t * t * t AS rho FROM a),
c AS (SELECT *, CASE WHEN n > 0 THEN u / n * rho ELSE 0 END AS p, CASE WHEN n > 0 THEN v / n * rho ELSE 0 END AS q FROM b) SELECT frame, x, y, round(p * 0.999::DOUBLE + q * 0.002::DOUBLE + 310, 6) + 0.0 AS row, round(p * 0.001::DOUBLE + q + 305, 6) + 0.0 AS col FROM c""")
def i1_camera_pixel(spark, sf_dir):
    ray = tuple(c.cast("double") for c in (F.col("x") - 12, F.col("y") - 12, (F.col("value") - 100) / 10))
    row, col = N.camera_pixel(ray, (310.0, 305.0), (0.999, 0.002, 0.001), [300.0, 170.0, 12.0, -3.0])
    return field(spark, sf_dir).select("frame", "x", "y", r(row).alias("row"), r(col).alias("col"))


_STAR = {(0, 0): 9.0, (1, 0): 4.0, (-1, 0): 4.0, (0, 1): 4.0, (0, -1): 4.0, (2, 2): 1.0, (-2, -2): 1.0}
_STAR_SUMS = f"{len(_STAR)} * sum(value * w) - sum(value) * {sum(_STAR.values())}", f"({len(_STAR)} * sum(value * value) - sum(value) ** 2) * ({len(_STAR)} * {sum(w * w for w in _STAR.values())} - {sum(_STAR.values())} ** 2)"


@query(f"""WITH {FIELD}, w AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {w})' for (a, b), w in _STAR.items())}) t(dx, dy, w)), c AS (SELECT frame, x - dx AS x, y - dy AS y, {_STAR_SUMS[0]} AS top, {_STAR_SUMS[1]} AS spread FROM f, w GROUP BY ALL HAVING count(*) = {len(_STAR)}),
k AS (SELECT frame, x, y, round((top / sqrt(spread::DOUBLE))::DOUBLE, 9) + 0.0 AS score FROM c WHERE spread > 0) SELECT frame, x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, x, y) AS i FROM k) WHERE i = 1""")
def i17_template_match(spark, sf_dir):
    return I.template_match(field(spark, sf_dir), "frame", _STAR).withColumn("score", r(F.col("score"), 9))


_CRITERIA = ["l_discount * 10", "l_tax * 10", "l_quantity / 50"]


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN -1 WHEN l_partkey % 4 = 0 THEN CASE WHEN l_quantity > 40 THEN -9 ELSE 1 END WHEN {' AND '.join(f'{c} <= {m}' for c, m in zip(_CRITERIA, (0.7, 0.5, 0.6)))} THEN 2 WHEN {' AND '.join(f'{c} >= {m}' for c, m in zip(_CRITERIA, (0.2, 0.3, 0.4)))} THEN 4 ELSE 3 END AS flag FROM lineitem")
def i12_sun_decision(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem")
    flag = I.sun_decision(F.col("l_suppkey") % 9 != 0, F.col("l_partkey") % 4 != 0, F.col("l_quantity"), [F.expr(c) for c in _CRITERIA], [0.7, 0.5, 0.6], [0.2, 0.3, 0.4], 40.0)
    return n.select("l_orderkey", "l_linenumber", flag.alias("flag"))


_SKY = f"{FIELD}, sky AS (SELECT frame, x, y, value % 12 AS noise, (x - 5 - frame % 12) ** 2 + (y - 13) ** 2 <= 25 + frame % 20 AS cloud FROM f)"


def _pictures(spark, sf_dir) -> str:
    """Sky images with a round cloud each, as files."""
    x, y, f = F.col("x"), F.col("y"), F.col("frame")
    cloud = (x - 5 - f % 12) ** 2 + (y - 13) ** 2 <= 25 + f % 20
    sky = lambda a, b: F.when(cloud, a).otherwise(b) + F.col("value") % 12
    path = logs.scratch(spark, "sky")
    logs.write_pixmaps(field(spark, sf_dir).select(f.alias("name"), "x", "y", sky(170, 50).alias("red"), sky(175, 90).alias("green"), sky(180, 200).alias("blue")), "name", path)
    return path


@query(f"WITH {_SKY} SELECT frame, x, y, cloud FROM sky WHERE (x - 20) ** 2 + (y - 3) ** 2 > 4")
def i13_cloud_mask(spark, sf_dir):
    """From image files to cloud masks; the SQL has the clouds that were painted."""
    p = logs.pixmaps(spark, _pictures(spark, sf_dir)).withColumn("frame", F.regexp_extract("path", r"name=(\d+)", 1).cast("long")).drop("path")
    s = V.Segmentation(tile=8, reach=2, half_gap=1, step=0.2, resolution=0.4, pad=0.4, sun_radius=2, wide_sun_radius=4, clear_radius=2, outer_radius=10.0)
    suns = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.lit(20.0).alias("sun_x"), F.lit(3.0).alias("sun_y"), F.lit(1).alias("flag"))
    return V.segment(p, suns, "frame", s, (24, 24)).where("cloud is not null").select("frame", "x", "y", "cloud")


_SPOT = "4 + frame % 15 AS sx, 5 + frame % 13 AS sy"


@query(f"""WITH {FIELD}, g AS (SELECT frame, x, y, {_SPOT}, unnest([0, 1, 2]) AS channel, unnest([value, (value * 7 + x) % 256, (value * 5 + y) % 256]) AS v FROM f),
a AS (SELECT * FROM g WHERE abs(x - sx) <= 9 AND abs(y - sy) <= 9),
m AS (SELECT a.frame, a.channel, a.x, a.y, a.sx, a.sy, median(b.v)::DOUBLE AS v FROM a JOIN a b ON a.frame = b.frame AND a.channel = b.channel AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL),
h AS (SELECT * EXCLUDE (v), avg(v) OVER (PARTITION BY frame, channel, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM m), k AS (SELECT * EXCLUDE (v), avg(v) OVER (PARTITION BY frame, channel, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM h),
n AS (SELECT *, min(round(v, 9)) OVER (PARTITION BY frame, channel) AS low FROM k WHERE (x - sx) ** 2 + (y - sy) ** 2 <= 25),
p AS (SELECT frame, channel, sx, sy, round(avg(x))::BIGINT AS spot_x, round(avg(y))::BIGINT AS spot_y, min(low) AS low FROM n WHERE round(v, 9) <= low + 5 GROUP BY ALL)
SELECT p.frame, p.channel, spot_x, spot_y, round(median(k.v) - any_value(p.low), 6) + 0.0 AS contrast, round(sqrt((spot_x - p.sx) ** 2 + (spot_y - p.sy) ** 2), 6) + 0.0 AS error FROM p JOIN k ON p.frame = k.frame AND p.channel = k.channel AND (k.x - spot_x) ** 2 + (k.y - spot_y) ** 2 BETWEEN 4 AND 16 GROUP BY p.frame, p.channel, spot_x, spot_y, p.sx, p.sy""")
def i12_sun_spots(spark, sf_dir):
    v, x, y = F.col("value"), F.col("x"), F.col("y")
    p = field(spark, sf_dir).select("frame", "x", "y", v.alias("red"), ((v * 7 + x) % 256).alias("green"), ((v * 5 + y) % 256).alias("blue"))
    k = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(k.alias("frame"), (4 + k % 15).cast("double").alias("sun_x"), (5 + k % 13).cast("double").alias("sun_y"))
    got = V.sun_spots(p, places, "frame", V.SunSearch(reach=5, core=1, inner=2, outer=4))
    return got.select("frame", "channel", "spot_x", "spot_y", r(F.col("contrast")).alias("contrast"), r(F.col("error")).alias("error"))


_WAVES = "100 + 40 * sin((x - {u}) / 5.0::DOUBLE) * cos((y - {v}) / 4.0::DOUBLE) + 30 * cos((x - {u}) / 7.0::DOUBLE + (y - {v}) / 6.0::DOUBLE)".format


def _move(n: int) -> str:
    """One round of the motion search in SQL, from m{n} to m{n + 1}."""
    return f"""w{n} AS (SELECT b.frame, b.x + floor(u)::BIGINT + i AS x, b.y + floor(v)::BIGINT + j AS y, sum(b.value * CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE j WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS value, count(*) FILTER (CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE j WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END > 0) AS c, sum(CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE j WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS s FROM b JOIN m{n} m USING (frame), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j) GROUP BY ALL),
g{n} AS (SELECT frame, x, y, value, CASE WHEN lead(x) OVER h - lag(x) OVER h = 2 THEN (lead(value) OVER h - lag(value) OVER h) / 2 END AS gx, CASE WHEN lead(y) OVER k - lag(y) OVER k = 2 THEN (lead(value) OVER k - lag(value) OVER k) / 2 END AS gy FROM w{n} WHERE s > 1 - 1e-9 WINDOW h AS (PARTITION BY frame, y ORDER BY x), k AS (PARTITION BY frame, x ORDER BY y)),
s{n} AS (SELECT frame, sum(gx * gx) AS xx, sum(gx * gy) AS xy, sum(gy * gy) AS yy, sum(gx * (a.value - g.value)) AS xr, sum(gy * (a.value - g.value)) AS yr FROM g{n} g JOIN a USING (frame, x, y) WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY frame),
m{n + 1} AS (SELECT m.frame, u - (yy * xr - xy * yr) / (xx * yy - xy * xy) AS u, v - (xx * yr - xy * xr) / (xx * yy - xy * xy) AS v FROM m{n} m JOIN s{n} USING (frame))"""


@query(f"""WITH {FIELD}, b AS (SELECT frame, x, y, {_WAVES(u="0", v="0")} AS value FROM f), a AS (SELECT frame, x, y, {_WAVES(u="(frame % 9) / 5.0::DOUBLE", v="(frame % 7) / -4.0::DOUBLE")} AS value FROM f), m0 AS (SELECT DISTINCT frame, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM f), {_move(0)}, {_move(1)}, {_move(2)} SELECT frame, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM m3""")
def i6_fine_motion(spark, sf_dir):
    f, x, y = (F.col(c) for c in ("frame", "x", "y"))
    look = lambda u, v: 100 + 40 * F.sin((x - u) / 5.0) * F.cos((y - v) / 4.0) + 30 * F.cos((x - u) / 7.0 + (y - v) / 6.0)
    p = field(spark, sf_dir)
    before, after = p.withColumn("value", look(F.lit(0), F.lit(0))), p.withColumn("value", look((f % 9) / 5.0, (f % 7) / -4.0))
    return I.fine_motion(before, after, "frame", (1,), 3).select("frame", r(F.col("u")).alias("u"), r(F.col("v")).alias("v"))


# ---- learning and physics --------------------------------------------------------------------------


@query()
def l6_grid_search(spark, sf_dir):
    got = L.grid_search(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey", [0.0, 1.0, 100.0, 1e4, 1e6])
    return spark.createDataFrame([(i, c, round(e, 4)) for i, (c, e) in enumerate(got)], "place long, penalty double, rmse double")


ADR = {"pnom": 500.0, "vnom": 350.0, "pacmax": 480.0, "pnt": 0.6, "b": [0.01, 0.02, 0.003, 0.001, 0.004, 0.0005, 0.002, 0.006, 0.001]}


@query(f"""WITH {SAMPLES}, a AS (SELECT *, ghi / 500 AS p, (300 + l_linenumber * 20) / 350 AS v FROM s), b AS (SELECT *, 500 * (p - (0.01 + 0.02 * p + 0.003 * p * p + (v - 1) * (0.001 + 0.004 * p + 0.0005 * p * p) + (1 / v - 1) * (0.002 + 0.006 * p + 0.001 * p * p))) AS ac FROM a)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ac < -0.6 THEN -0.6 ELSE least(ac, 480) END, 6) + 0.0 AS ac FROM b""")
def adr_inverter(spark, sf_dir):
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", r(S.adr_inverter((300 + F.col("l_linenumber") * 20).cast("double"), F.col("ghi"), ADR)).alias("ac"))


@query(f"WITH {SAMPLES} SELECT l_orderkey, l_linenumber, CASE WHEN zenith < 90 THEN round(greatest(-60, least(60, degrees(atan2({SIN('zenith')} * sin(radians(doy * 1.0 - 180)), {COS('zenith')})))), 6) + 0.0 END AS angle FROM s")
def tracker_angle(spark, sf_dir):
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", r(S.tracker_angle(F.col("zenith"), F.col("doy").cast("double"), 180.0, 60.0)).alias("angle"))


_T, _O = "radians(12.0)", "radians(-25.0)"
_AXIS = f"""n AS (SELECT *, sin(theta) AS nx, cos(theta) AS nz FROM (SELECT *, greatest(radians(-55.0), least(radians(55.0), CASE WHEN wide < 0 THEN wide + back ELSE wide - back END)) AS theta FROM (SELECT *, acos(least(1, greatest(-1, cos(wide) / 0.4))) AS back FROM (SELECT *, atan2(xp, zp) AS wide FROM (SELECT l_orderkey, l_linenumber, zenith, x * cos({_O}) - y * sin({_O}) AS xp, x * sin({_T}) * sin({_O}) + y * sin({_T}) * cos({_O}) + up * cos({_T}) AS zp
FROM (SELECT *, sin(radians(zenith)) * sin(radians(doy::DOUBLE - 180)) AS x, sin(radians(zenith)) * cos(radians(doy::DOUBLE - 180)) AS y, cos(radians(zenith)) AS up FROM s))))))"""


@query(f"""WITH {SAMPLES}, {_AXIS}, k AS (SELECT *, degrees(atan2(nx * cos({_O}) + nz * sin({_T}) * sin({_O}), -nx * sin({_O}) + nz * sin({_T}) * cos({_O}))) + 180 AS turn FROM n WHERE zenith < 90)
SELECT l_orderkey, l_linenumber, round(degrees(theta), 4) + 0.0 AS theta, round(degrees(acos(least(1, abs(xp * nx + zp * nz)))), 4) + 0.0 AS incidence, round(degrees(acos(nz * cos({_T}))), 4) + 0.0 AS surface_tilt, round(turn - 360 * floor(turn / 360), 4) + 0.0 AS surface_azimuth FROM k""")
def tracker_tilted(spark, sf_dir):
    """A tracker of a tilted axis whose rows turn back from each other's shade."""
    s = samples(spark, sf_dir).where("zenith < 90").withColumn("azimuth", F.col("doy").cast("double"))
    got = S.with_single_axis(s, "zenith", "azimuth", 12.0, 155.0, 55.0, 0.4)
    return got.select("l_orderkey", "l_linenumber", *[r(F.col(k), 4).alias(k) for k in ("theta", "incidence", "surface_tilt", "surface_azimuth")])


MODULE = {"isc0": 5.1, "imp0": 4.6, "voc0": 43.5, "vmp0": 34.4, "ix0": 5.0, "ixx0": 3.3, "aisc": 0.0006, "aimp": -0.0002, "bvoc": -0.15, "mbvoc": 0.01, "bvmp": -0.16, "mbvmp": 0.02, "n": 1.2, "ns": 72.0, "c0": 1.01, "c1": -0.01, "c2": 0.3, "c3": -7.5, "c4": 0.99, "c5": 0.01, "c6": 1.1, "c7": -0.1}
_POINT = {
    "isc": "isc0 * e * (1 + aisc * dt)", "imp": "imp0 * (c0 * e + c1 * e * e) * (1 + aimp * dt)", "voc": "voc0 + ns * fall + (bvoc + mbvoc * (1 - e)) * dt", "vmp": "vmp0 + c2 * ns * fall + c3 * ns * fall * fall + (bvmp + mbvmp * (1 - e)) * dt",
    "ix": "ix0 * (c4 * e + c5 * e * e) * (1 + aisc * dt)", "ixx": "ixx0 * (c6 * e + c7 * e * e) * (1 + aisc * dt)",
}
_POINT["pmp"] = f"({_POINT['imp']}) * ({_POINT['vmp']})"


@query(f"""WITH {SAMPLES}, m AS (SELECT {', '.join(f'{v}::DOUBLE AS {k}' for k, v in MODULE.items())}), e AS (SELECT l_orderkey, l_linenumber, (clear - 40) / 1000.0::DOUBLE AS e, (20 + l_linenumber * 5 - 25)::DOUBLE AS dt FROM s),
d AS (SELECT *, n * 8.617332478e-5::DOUBLE * (dt + 298.15::DOUBLE) * ln(greatest(e, 0.001)) AS fall FROM e, m) SELECT l_orderkey, l_linenumber, {', '.join(f'CASE WHEN e >= 0.001 THEN round({x}, 6) + 0.0 ELSE 0 END AS {k}' for k, x in _POINT.items())} FROM d""")
def sapm_points(spark, sf_dir):
    points = S.sapm((F.col("clear") - 40) / 1000, (20 + F.col("l_linenumber") * 5).cast("double"), MODULE)
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", *[r(c).alias(k) for k, c in points.items()])


_CLASS = lambda c, lower: "(" + " + ".join(f"({c} >= {x})::INTEGER" for x in lower) + ")"


@query(f"""WITH {SAMPLES}, {DISC}, o AS (SELECT *, least(0.82, k / (1.031 * exp(-1.4 / (0.9 + 9.4 / (1 / ({COS('zenith')} + 0.15 * (93.885 - zenith) ** -1.253)))) + 0.1)) AS kp, 10 + l_linenumber * 4 AS dew FROM d),
b AS (SELECT *, coalesce(lag(kp) OVER w, lead(kp) OVER w) AS p, coalesce(lead(kp) OVER w, lag(kp) OVER w) AS n FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, ghi, clear)),
g AS (SELECT *, {_CLASS('kp', S.DIRINT_KT)} AS c1, {_CLASS('zenith', S.DIRINT_ZENITH)} AS c2, CASE WHEN p IS NULL THEN 7 ELSE {_CLASS('0.5 * (abs(kp - n) + abs(kp - p))', S.DIRINT_CHANGE)} END AS c3, CASE WHEN l_linenumber = 3 THEN 5 ELSE {_CLASS('exp(0.07 * dew - 0.075)', S.DIRINT_WATER)} END AS c4 FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN zenith > 87 OR ghi < 1 OR dn < 0 THEN 0 ELSE dn END * (0.5 + (c1 * 31 + c2 * 17 + c3 * 7 + c4 * 3) % 20 / 20), 3) + 0.0 AS dni FROM g""")
def dirint_dni(spark, sf_dir):
    """The classes and the lookup; the coefficients are a rule's, as the published table is the caller's."""
    upto = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    table_ = spark.range(1).select(upto(6).alias("kt")).select("*", upto(6).alias("z")).select("*", upto(7).alias("change")).select("*", upto(5).alias("water"))
    table_ = table_.withColumn("coefficient", 0.5 + (F.col("kt") * 31 + F.col("z") * 17 + F.col("change") * 7 + F.col("water") * 3) % 20 / 20)
    s = samples(spark, sf_dir).withColumn("dew", F.when(F.col("l_linenumber") != 3, 10 + F.col("l_linenumber") * 4))
    return T.dirint(s, ["l_orderkey"], ["l_linenumber", "ghi", "clear"], "ghi", "zenith", "doy", table_, dew_point="dew").select("l_orderkey", "l_linenumber", r(F.col("dni"), 3).alias("dni"))


@query(f"WITH {E} SELECT event_id, {', '.join(f'lag(value, {i}) OVER w AS value_{i}, lag(t, {i}) OVER w AS t_{i}' for i in (1, 2, 5))} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def l13_lagged_inputs(spark, sf_dir):
    got = T.lagged(events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value", "t"], [1, 2, 5])
    return got.select("event_id", *[f"{v}_{i}" for v in ("value", "t") for i in (1, 2, 5)])


_DET = "a{0} * (b{1} * c{2} - b{2} * c{1}) - a{1} * (b{0} * c{2} - b{2} * c{0}) + a{2} * (b{0} * c{1} - b{1} * c{0})".format  # of columns a, b, c
_CO = lambda i, j: f"covar_pop(v{i}, v{j})"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, value AS v0, {", ".join(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v{k}" for k in (1, 2, 3))} FROM events),
m AS (SELECT {", ".join(f"{_CO(i, j)} AS {x}{i}" for j, x in ((1, "a"), (2, "b"), (3, "c"), (0, "y")) for i in (1, 2, 3))}, avg(v0) AS m0, avg(v1) AS m1, avg(v2) AS m2, avg(v3) AS m3 FROM e WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL),
s AS (SELECT *, {", ".join(f"({_DET(1, 2, 3).replace(x, 'y')}) / ({_DET(1, 2, 3)}) AS k{n}" for n, x in enumerate("abc", 1))} FROM m)
SELECT '1' AS term, round(m0 - k1 * m1 - k2 * m2 - k3 * m3, 6) + 0.0 AS coefficient FROM s {" ".join(f"UNION ALL SELECT 'value_{n}', round(k{n}, 6) + 0.0 FROM s" for n in (1, 2, 3))}""")
def l13_autoregression(spark, sf_dir):
    """A linear model of the value by the values before it, as its coefficients."""
    got = T.lagged(events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value"], [1, 2, 3])
    beta = L.least_squares(got, ["value_1", "value_2", "value_3"], "value", interactions=False)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in beta.items()], "term string, coefficient double")


_WEIGHTS = [0.7, -0.4, 0.1, -0.3, 0.9, 0.2, 0.8, -0.6, 0.05]  # of two units over two lags
_SCALED = "({} / 100 - 1)".format
_UNITS = lambda a, b: f"(0.8::DOUBLE * tanh(0.7::DOUBLE * {_SCALED(a)} - 0.4::DOUBLE * {_SCALED(b)} + 0.1::DOUBLE) - 0.6::DOUBLE * tanh(-0.3::DOUBLE * {_SCALED(a)} + 0.9::DOUBLE * {_SCALED(b)} + 0.2::DOUBLE) + 0.05::DOUBLE + 1) * 100"


@query(f"""WITH RECURSIVE {E}, l AS (SELECT user_id, value::DOUBLE AS a, lag(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS i FROM e),
k AS (SELECT user_id, 0 AS step, a, b FROM l WHERE i = 1 UNION ALL SELECT user_id, step + 1, {_UNITS("a", "b")}, a FROM k WHERE step < 6)
SELECT user_id, step, round(a, 6) + 0.0 AS y_hat FROM k WHERE step > 0""")
def l13_closed_loop(spark, sf_dir):
    """Six rows beyond each user's events by a network of given weights, fed with its own output."""
    ends = {"value_1": (0.0, 200.0), "value_2": (0.0, 200.0), "value": (0.0, 200.0)}
    net = N5.Network(["value_1", "value_2"], "value", ends, 2, np.array(_WEIGHTS), [])
    e = events(spark, sf_dir).select("user_id", "t", "event_id", "value")
    return N5.forecast(e, net, ["user_id"], ["t", "event_id"], "value", [1, 2], 6).select("user_id", "step", r(F.col("y_hat")).alias("y_hat"))


@query()
def l13_network(spark, sf_dir):
    """The next value by the three before and the hours since the event before: root mean squared errors of a fitted network
    and of the mean over the rows that have all inputs."""
    e = events(spark, sf_dir).select("user_id", "t", "event_id", "value", (F.col("t") / 3.6e9).alias("hour"))
    e = T.lagged(e, ["user_id"], ["t", "event_id"], ["hour"], [1]).select("user_id", "t", "event_id", "value", (F.col("hour") - F.col("hour_1")).alias("gap"))
    _, got = N5.autoregressive_network(e, ["user_id"], ["t", "event_id"], "value", [1, 2, 3], "event_id", ["gap"], [1], hidden=6, rounds=20)
    got = got.where("y_hat is not null and value is not null")
    return got.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y_hat") - F.col("value")) ** 2)).alias("rmse"), F.stddev_pop("value").alias("spread"))


@query()
def i11_bounded_fit(spark, sf_dir):
    beta = L.bounded_least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", {"l_discount": 0.0, "l_tax": 0.0}, {"1": 100.0, "l_quantity": 1000.0}, weight=F.col("l_linenumber"))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in beta.items()], "term string, coefficient double")


@query("""WITH d AS (SELECT q.p_partkey AS id, p.p_partkey AS pid, abs(q.p_retailprice - p.p_retailprice) AS far, p.p_retailprice - q.p_retailprice AS dx, p.p_size::DOUBLE AS y FROM part q JOIN part p ON q.p_partkey % 100 = 0),
k AS (SELECT *, max(far) OVER (PARTITION BY id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, pid) AS i FROM d) WHERE i <= 20),
w AS (SELECT *, (1 - CASE WHEN f > 0 THEN (far / (f * 1.0001)) ** 3 ELSE 0 END) ** 3 AS w FROM k),
s AS (SELECT id, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * y) AS t0, sum(w * dx * y) AS t1 FROM w GROUP BY id)
SELECT id, round(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 4) + 0.0 AS y FROM s""")
def l12_local_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return L.local_linear(q, p, "id", "p_partkey", "p_retailprice", "p_size").select("id", r(F.col("y"), 4).alias("y"))


@query()
def l12_tree_ensemble(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return L.tree_ensemble(n, ["l_quantity", "l_discount"], "l_extendedprice").select(F.sqrt(F.avg((F.col("prediction") - F.col("l_extendedprice")) ** 2)).alias("rmse"))


@query()
def l2_robust_fit(spark, sf_dir):
    beta = L.robust_least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(k, round(v, 3)) for k, v in beta.items()], "term string, coefficient double")


_P = PLACE["latitude"]
_SERIES = lambda kind: "(" + " + ".join(f"({' + '.join(f'{float(a)} * cos({float(b)} + {float(c)} * jme)' for a, b, c in rows)}) * jme ** {k}" for k, rows in enumerate(S.EARTH[kind])) + ") / 1e8"
_TURN = lambda n: "radians(" + " + ".join(f"({k}) * x{i}" for i, k in enumerate(n)) + ")"
_POWERS = lambda x, cs: " + ".join(f"({c!r}::DOUBLE) * {x} ** {k}" for k, c in enumerate(cs))


@query(f"""WITH {E}, a AS (SELECT *, date_diff('day', DATE '2000-01-01', ts::DATE) - 0.5::DOUBLE + (hour(ts) + minute(ts) / 60 + second(ts) / 3600) / 24 AS d FROM e),
b AS (SELECT *, d / 36525 AS jc, (d + (66.3::DOUBLE + 0.6175::DOUBLE * (year(ts) - 2012)) / 86400) / 36525 AS jce FROM a),
c AS (SELECT *, jce / 10 AS jme, {", ".join(f"{_POWERS('jce', cs)} AS x{i}" for i, cs in enumerate(S.ANGLES))} FROM b),
f AS (SELECT *, degrees({_SERIES("longitude")}) AS l, -degrees({_SERIES("latitude")}) AS beta, {_SERIES("distance")} AS far,
 ({" + ".join(f"({p}::DOUBLE + {q}::DOUBLE * jce) * sin({_TURN(n)})" for n, p, q, _, _ in S.NUTATION)}) / 36000000 AS psi, ({_POWERS("(jme / 10)", S.OBLIQUITY)}) / 3600 + ({" + ".join(f"({p}::DOUBLE + {q}::DOUBLE * jce) * cos({_TURN(n)})" for n, _, _, p, q in S.NUTATION)}) / 36000000 AS eps FROM c),
g AS (SELECT *, l + 180 + psi - 20.4898::DOUBLE / (3600 * far) AS lam, 8.794::DOUBLE / (3600 * far) AS xi, 280.46061837::DOUBLE + 360.98564736629::DOUBLE * d + 0.000387933::DOUBLE * jc * jc - jc ** 3 / 38710000 + psi * cos(radians(eps)) AS nu FROM f),
h AS (SELECT *, degrees(atan2(sin(radians(lam)) * cos(radians(eps)) - tan(radians(beta)) * sin(radians(eps)), cos(radians(lam)))) AS ra, asin(sin(radians(beta)) * cos(radians(eps)) + cos(radians(beta)) * sin(radians(eps)) * sin(radians(lam))) AS dec,
 cos(atan(0.99664719::DOUBLE * tan(radians({_P})))) + {PLACE["altitude"]} / 6378140 * cos(radians({_P})) AS ox, 0.99664719::DOUBLE * sin(atan(0.99664719::DOUBLE * tan(radians({_P})))) + {PLACE["altitude"]} / 6378140 * sin(radians({_P})) AS oy FROM g),
i AS (SELECT *, radians(nu + {PLACE["longitude"]} - ra) AS ha FROM h), j AS (SELECT *, atan2(-ox * sin(radians(xi)) * sin(ha), cos(dec) - ox * sin(radians(xi)) * cos(ha)) AS da FROM i),
k AS (SELECT *, atan2((sin(dec) - oy * sin(radians(xi))) * cos(da), cos(dec) - ox * sin(radians(xi)) * cos(ha)) AS dt, ha - da AS ht FROM j),
m AS (SELECT *, degrees(asin(sin(radians({_P})) * sin(dt) + cos(radians({_P})) * cos(dt) * cos(ht))) AS el, 180 + degrees(atan2(sin(ht), cos(ht) * sin(radians({_P})) - tan(dt) * cos(radians({_P})))) AS az FROM k)
SELECT event_id, round(az - 360 * floor(az / 360), 5) + 0.0 AS azimuth, round(el, 5) + 0.0 AS elevation, round(el + CASE WHEN el >= -0.83337::DOUBLE THEN 100 * ((44331.514::DOUBLE - {PLACE["altitude"]}) / 11880.516::DOUBLE) ** (1 / 0.1902632::DOUBLE) / 101000 * 283 / 285 * 1.02::DOUBLE / (60 * tan(radians(el + 10.3::DOUBLE / (el + 5.11::DOUBLE)))) ELSE 0 END, 5) + 0.0 AS apparent_elevation FROM m""")
def precise_sun_position(spark, sf_dir):
    ts = F.col("ts")
    days = F.datediff(F.to_date(ts), F.lit("2000-01-01").cast("date")) - 0.5 + (F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600) / 24
    e = S.with_precise_sun_position(events(spark, sf_dir), days, PLACE["latitude"], PLACE["longitude"], PLACE["altitude"], S.pressure_of(PLACE["altitude"]))
    return e.select("event_id", *[r(F.col(c), 5).alias(c) for c in ("azimuth", "elevation", "apparent_elevation")])


@query(f"WITH {SAMPLES} SELECT l_orderkey, l_linenumber, round(100 * ((44331.514 - clear) / 11880.516) ** (1 / 0.1902632::DOUBLE), 4) + 0.0 AS pressure, round(44331.5 - 4946.62 * (90000 + clear) ** 0.190263::DOUBLE, 6) + 0.0 AS altitude FROM s")
def pressure_altitude(spark, sf_dir):
    clear = F.col("clear").cast("double")
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", r(S.pressure_of(clear), 4).alias("pressure"), r(S.altitude_of(90000 + clear)).alias("altitude"))


def _scaled(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    return n.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))


def _fit(df: DataFrame) -> DataFrame:
    m = A.error_metrics(F.col("y"), F.col("y_hat"))
    return df.agg(m["n"].alias("n"), r(m["rmse"], 2).alias("rmse"), r(m["r2"], 3).alias("r2"))


@query()
def l5_epsilon_machine(spark, sf_dir):
    """Fitted on up to 800 rows, in blocks of 200, with the published penalty; every row is predicted."""
    d = _scaled(spark, sf_dir)
    return _fit(M.epsilon_machine(d, ["q", "d"], "y", "id", c=250.0, epsilon=4.0, gamma=2.0, most=800, block=200, gap=0.01).predict(d, ["q", "d"]))


@query()
def l6_machine_grid(spark, sf_dir):
    """Cross-validated errors over the grid of margins, widths and penalties."""
    got = M.machine_grid(_scaled(spark, sf_dir), ["q", "d"], "y", "id", [1.0, 4.0, 9.0], [0.5, 2.0, 8.0], [50.0, 250.0], most=250)
    return got.select("epsilon", "gamma", "c", r(F.col("rmse"), 3).alias("rmse"))


@query()
def l12_relevance(spark, sf_dir):
    """Fitted on up to 600 rows; every row is predicted."""
    d = _scaled(spark, sf_dir)
    return _fit(M.relevance(d, ["q", "d"], "y", "id", gamma=1.0, most=600)[0].predict(d, ["q", "d"]))


_KNOTS = {"l_quantity": [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0], "l_discount": [0.025, 0.055, 0.075], "l_linenumber": [1.5, 2.5, 4.5]}
_CUTS = " UNION ALL ".join(f"SELECT {100 * i + j} AS o, {k}::DOUBLE AS k, i, p, {f}::DOUBLE <= {k}::DOUBLE AS l, y FROM LEVEL" for i, (f, ks) in enumerate(_KNOTS.items()) for j, k in enumerate(ks))
_SPLIT = lambda n: f"""g{n} AS (SELECT p, o, k, sum(c) AS c, max(sd_all) - sum(c * sd) / sum(c) AS gain, min(c) AS least, count(*) AS sides FROM (SELECT p, o, k, l, count(*) AS c, coalesce(stddev_pop(y), 0) AS sd FROM ({_CUTS.replace("LEVEL", f"x{n}")}) GROUP BY ALL) JOIN (SELECT p, stddev_pop(y) AS sd_all FROM x{n} GROUP BY p) USING (p) GROUP BY p, o, k),
b{n} AS (SELECT p, o, k FROM g{n} WHERE sides = 2 AND least >= 50 AND round(gain, 9) > 0 QUALIFY row_number() OVER (PARTITION BY p ORDER BY round(gain, 9) DESC, o) = 1),
x{n + 1} AS (SELECT x.* EXCLUDE (p), x.p || CASE WHEN b.p IS NULL THEN '' WHEN CASE o // 100 {" ".join(f"WHEN {i} THEN {f}::DOUBLE" for i, f in enumerate(_KNOTS))} END <= k THEN 'l' ELSE 'r' END AS p FROM x{n} x LEFT JOIN b{n} b ON x.p = b.p)"""  # noqa: E731


@query(f"WITH x0 AS (SELECT row_number() OVER () AS i, l_quantity, l_discount, l_linenumber, l_extendedprice::DOUBLE AS y, '' AS p FROM lineitem), {_SPLIT(0)}, {_SPLIT(1)}, {_SPLIT(2)} SELECT p AS leaf, count(*) AS n, round(avg(y), 3) + 0.0 AS mean, round(stddev_pop(y), 3) + 0.0 AS sd FROM x3 GROUP BY p")
def l12_model_tree(spark, sf_dir):
    """The leaves of a tree of three levels by given knots, as paths from the root; the SQL searches all splits."""
    n = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in (*_KNOTS, "l_extendedprice")])
    root = R5.model_tree(n, list(_KNOTS), "l_extendedprice", knots=_KNOTS, depth=3, least=50, flat=0.0, linear=False, prune=False, smoothing=0)
    path = {}

    def walk(node, p):
        path[id(node)] = p
        if node.feature is not None:
            walk(node.left, p + "l")
            walk(node.right, p + "r")

    walk(root, "")
    return n.groupBy(root.column(lambda leaf: F.lit(path[id(leaf)])).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 3).alias("mean"), r(F.stddev_pop("l_extendedprice"), 3).alias("sd"))


@query()
def l12_model_tree_fit(spark, sf_dir):
    """A pruned and smoothed model tree with linear leaves; every row is predicted."""
    d = _scaled(spark, sf_dir)
    root = R5.model_tree(d, ["q", "d"], "y", depth=4)
    return _fit(d.withColumn("y_hat", R5.tree_prediction(root)))


_HINGES = " UNION ALL ".join(f"SELECT {100 * i + j} AS o, '{f}' AS feature, {k}::DOUBLE AS knot, greatest(0, {f}::DOUBLE - {k}) AS u, greatest(0, {k} - {f}::DOUBLE) AS v, l_extendedprice::DOUBLE AS y FROM lineitem" for i, (f, ks) in enumerate(_KNOTS.items()) for j, k in enumerate(ks))
_MOMENTS = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("uu", "vv", "uv", "uy", "vy"))


@query(f"""WITH m AS (SELECT o, feature, knot, {_MOMENTS}, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM ({_HINGES}) GROUP BY ALL),
b AS (SELECT *, uu * vv - uv * uv AS det FROM m), k AS (SELECT *, (uy * vv - vy * uv) / det AS above, (vy * uu - uy * uv) / det AS below FROM b),
w AS (SELECT * FROM k ORDER BY above * uy + below * vy DESC, o LIMIT 1)
SELECT feature, knot, round(above, 4) + 0.0 AS above, round(below, 4) + 0.0 AS below, round(my - above * mu - below * mv, 4) + 0.0 AS intercept FROM w""")
def l12_first_splines(spark, sf_dir):
    """The first pair of hinges, of all features' given knots, and its coefficients over all rows; the SQL tries every pair."""
    m = P.adaptive_splines(table(spark, sf_dir, "lineitem"), list(_KNOTS), "l_extendedprice", _KNOTS, most=3, least_gain=0.0, prune=False)
    (i, knot, _), side = m.terms[1][0], {t[0][2]: c for t, c in zip(m.terms[1:], m.coefficients[1:], strict=True)}
    return spark.createDataFrame([(m.features[i], knot, round(side[1], 4), round(side[-1], 4), round(m.coefficients[0], 4))], "feature string, knot double, above double, below double, intercept double")


@query()
def l12_splines(spark, sf_dir):
    """Products of hinges at quantiles, pruned; every row is predicted."""
    d = _scaled(spark, sf_dir)
    return _fit(d.withColumn("y_hat", P.adaptive_splines(d, ["q", "d"], "y", most=11).column()))


@query()
def l12_hinges(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    _, _, f = L.hinge_regression(n, ["l_quantity", "l_discount"], "l_extendedprice")
    return n.select(F.sqrt(F.avg((f - F.col("l_extendedprice")) ** 2)).alias("rmse"))


@query()
def l12_radial_network(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), "l_extendedprice")
    _, f = L.radial_network(n, ["q", "d"], "l_extendedprice", [[i / 4, j / 2] for i in range(5) for j in range(3)], 0.3)
    return n.select(F.sqrt(F.avg((f - F.col("l_extendedprice")) ** 2)).alias("rmse"))


@query()
def l16_sun_pixels(spark, sf_dir):
    """The linear classifier's share of right pixels; a pixel of the sun is bright and near the middle."""
    f = field(spark, sf_dir).select((F.col("value") / 255).alias("v"), (F.sqrt((F.col("x") - 12) ** 2 + (F.col("y") - 12) ** 2) / 12).alias("d"))
    f = f.withColumn("sun", (F.col("v") > 0.3 + F.col("d")).cast("int"))
    b, w = L.linear_classifier(f, ["v", "d"], "sun")
    right = ((w["v"] * F.col("v") + w["d"] * F.col("d") + b > 0).cast("int") == F.col("sun")).cast("double")
    return f.select(F.avg(right).alias("right"))


@query(f"""WITH {FIELD}, p AS (SELECT frame::BIGINT AS frame, x, y, x // 10 AS tile_x, y // 10 AS tile_y, value // 16 AS lv FROM f WHERE value >= 16),
a AS (SELECT a.frame, a.tile_x AS ax, a.tile_y AS ay, b.tile_x AS bx, b.tile_y AS bb, least(a.lv, b.lv) AS lo, greatest(a.lv, b.lv) AS hi FROM p a JOIN p b ON a.frame = b.frame AND (b.x > a.x OR b.x = a.x AND b.y > a.y) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 12.25 WHERE abs(a.lv - b.lv) >= 4),
h AS (SELECT frame, ax AS tile_x, ay AS tile_y, lo, hi, count(*) AS c FROM a GROUP BY ALL UNION ALL SELECT frame, bx, bb, lo, hi, count(*) FROM a GROUP BY ALL),
k AS (SELECT *, unnest(range(1, 16)) AS level FROM (SELECT DISTINCT frame, tile_x, tile_y FROM p)),
s AS (SELECT frame, tile_x, tile_y, level, sum(c) / 2 AS separated FROM k JOIN h USING (frame, tile_x, tile_y) WHERE lo + 1 < level AND level < hi - 1 GROUP BY ALL),
n AS (SELECT frame, tile_x, tile_y, lv AS level, count(*) AS n FROM p GROUP BY ALL)
SELECT frame, tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, level::BIGINT AS level, coalesce(n, 0)::BIGINT AS n, coalesce(separated, 0)::DOUBLE AS separated FROM k LEFT JOIN s USING (frame, tile_x, tile_y, level) LEFT JOIN n USING (frame, tile_x, tile_y, level)""")
def i10_threshold_separation(spark, sf_dir):
    return I.threshold_separation(field(spark, sf_dir), "frame", F.floor(F.col("value") / 16), 15, 3.5, 1, 10)


# ---- sources and sinks, as round trips ---------------------------------------------------------------


def _lines(spark, df: DataFrame, column, tag: str) -> str:
    path = logs.scratch(spark, tag)
    df.select(column.alias("value")).write.text(path)
    return path


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND strftime(o_orderdate, '%Y-%m-%d') NOT IN ('1995-03-01', '1996-01-05') GROUP BY ALL")
def s1_days(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), logs.scratch(spark, "days")
    o.select("o_orderkey", F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).repartition("month").write.partitionBy("month").parquet(path)
    got = logs.days(spark.read.parquet(path), "1995-01", "1996-06", day="month")  # folders are pruned
    return logs.days(got, skip=("1995-03-01", "1996-01-05")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS irr1, value * 2 AS irr2, user_id::DOUBLE AS temp1, (event_id % 40)::DOUBLE AS temp2 FROM events")
def s5_logger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("0 0"), F.col("value").cast("string"), (F.col("value") * 2).cast("string"), F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string"))
    path = _lines(spark, e.withColumn("bad", F.explode(F.array(F.lit(False), F.lit(True)))), F.when(F.col("bad"), F.lit("no measurement here")).otherwise(line), "logger")
    return logs.logger(spark, path).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "irr1", "irr2", "temp1", "temp2")


_CELL = "CASE WHEN s_suppkey % 3 = 0 THEN 4.0::DOUBLE ELSE (s_suppkey * {} % 9)::DOUBLE END".format
_POWER = [f"CASE WHEN s_suppkey % 2 = 0 THEN {_CELL(w)} ELSE {_CELL(n)} END" for w, n in zip(logs.WIDE_POWER, logs.NARROW_POWER, strict=True)]


@query(f"SELECT s_suppkey::DOUBLE AS seconds, {' + '.join(_POWER)} AS p_total, {', '.join(f'{x} AS p{i + 1}' for i, x in enumerate(_POWER))}, {' AND '.join(f'CASE WHEN s_suppkey % 2 = 0 THEN {_CELL(w)} ELSE {_CELL(n)} END = 4' for w, n in zip(logs.WIDE_STATE, logs.NARROW_STATE, strict=True))} AS all_running FROM supplier")
def s6_power(spark, sf_dir):
    k = F.col("s_suppkey")
    cells = F.transform(F.sequence(F.lit(2), F.when(k % 2 == 0, 111).otherwise(35)), lambda i: F.when(k % 3 == 0, 4).otherwise(k * i % 9).cast("string"))
    return logs.power(spark, _lines(spark, table(spark, sf_dir, "supplier"), F.concat_ws("\t", k.cast("string"), cells), "power"))


@query("SELECT p_partkey::DOUBLE AS c1, p_retailprice AS c2, NULL::DOUBLE AS c3, p_partkey::VARCHAR AS t1, p_retailprice AS t2, p_brand || ',\"x\"; ' || p_type AS t3 FROM part".replace("p_retailprice AS t2", "'' AS t2").replace("p_retailprice AS c2", "NULL::DOUBLE AS c2"))
def s7_numbers(spark, sf_dir):
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(';,"'), "p_brand", F.lit(',""x""; '), "p_type", F.lit('"'))
    return logs.numbers(spark, _lines(spark, table(spark, sf_dir, "part"), line, "numbers"), 3)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start, round(60 * o_totalprice, 4) + 0.0 AS ghi, 60 * (o_orderkey % 7)::DOUBLE AS dni, 60 * (o_orderkey % 5)::DOUBLE AS dhi FROM orders")
def s8_clear_sky(spark, sf_dir):
    o, at = table(spark, sf_dir, "orders"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.S")
    line = F.concat_ws(";", F.concat_ws("/", at("o_orderdate"), at(F.col("o_orderdate") + F.expr("INTERVAL 1 MINUTE"))), F.lit("a;b;c;0"), F.col("o_totalprice").cast("string"), (F.col("o_orderkey") % 7).cast("string"), (F.col("o_orderkey") % 5).cast("string"), F.lit("1"))
    got = logs.clear_sky(spark, _lines(spark, o, line, "clear"))
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *[r(F.col(c), 4).alias(c) for c in ("ghi", "dni", "dhi")])


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total, md5(vec_id::VARCHAR || 'é') AS m, 195 + 169 AS last_two FROM embeddings")
def s14_blobs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("b", logs.to_blob(F.col("embedding").cast("array<double>"))).withColumn("s", F.to_binary(F.concat(F.col("vec_id").cast("string"), F.lit("é")), F.lit("utf-8")))
    path = logs.scratch(spark, "blobs")
    e.select("vec_id", "b", "s").write.parquet(path)
    back, by = logs.from_blob(F.col("b")), logs.bytes_of(F.col("s"))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(path).select("vec_id", F.size(back).cast("long").alias("n"), r(total).alias("total"), F.md5("s").alias("m"), (F.element_at(by, -1) + F.element_at(by, -2)).alias("last_two"))


@query("SELECT p_partkey::DOUBLE AS a, p_retailprice AS b, CASE WHEN p_size <> 7 THEN p_size::DOUBLE END AS c FROM part")
def s16_fixed_width(spark, sf_dir):
    line = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, " "), F.lpad(F.col("p_retailprice").cast("string"), 12, " "), F.lpad(F.when(F.col("p_size") == 7, "--").otherwise(F.col("p_size").cast("string")), 4, " "))
    return logs.fixed_width(spark, _lines(spark, table(spark, sf_dir, "part"), line, "fixed"), {"a": (1, 8), "b": (9, 12), "c": (21, 4)})


@query("SELECT p_partkey AS id, p_brand AS name, p_retailprice AS pmax FROM part")
def s17_parameters(spark, sf_dir):
    path = logs.scratch(spark, "library")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_retailprice").alias("pmax")).write.option("header", True).csv(path)
    return logs.parameters(spark, path).select(F.col("id").cast("long").alias("id"), "name", "pmax")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 11 <> 0 THEN value END AS v, event_type AS station FROM events")
def s18_weather(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), logs.scratch(spark, "weather")
    e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 11 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("v"), "event_type").write.csv(path)
    return logs.weather(spark, path, ["day", "v", "station"]).withColumn("v", F.col("v").cast("double"))


@query("SELECT s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def s19_config(spark, sf_dir):
    path = logs.scratch(spark, "config")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).write.format("xml").option("rootTag", "config").option("rowTag", "plant").save(path)
    return logs.config(spark, path, "plant").select(F.col("_id").cast("long").alias("id"), "name", F.round(F.col("balance").cast("double"), 2).alias("balance"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start, round(60 * o_totalprice, 4) + 0.0 AS ghi, 60 * (o_orderkey % 7)::DOUBLE AS dni, 60 * (o_orderkey % 5)::DOUBLE AS dhi, o_orderpriority AS place, 'c24' AS last FROM orders")
def s8_long_clear_sky(spark, sf_dir):
    o, at = table(spark, sf_dir, "orders"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.S")
    cells = {1: F.concat_ws("/", at("o_orderdate"), at(F.col("o_orderdate") + F.expr("INTERVAL 1 MINUTE"))), 2: F.col("o_orderpriority"), 3: F.col("o_totalprice"), 5: F.col("o_orderkey") % 5, 6: F.col("o_orderkey") % 7}
    line = F.concat_ws(";", *[cells[i].cast("string") if i in cells else F.lit(f"c{i}") for i in range(1, 25)])
    got = logs.clear_sky(spark, _lines(spark, o, line, "clear24"), (3, 6, 5), {"place": 2, "last": 24})
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *[r(F.col(c), 4).alias(c) for c in ("ghi", "dni", "dhi")], "place", "last")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, -1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0")
def k8_changed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    fifth = o.where(F.col("o_orderkey") % 5 == 0).withColumn("price", F.lit(-1.0))
    new = fifth.union(fifth.withColumn("o_orderkey", -F.col("o_orderkey")))
    return logs.changed(o, new, ["o_orderkey"], o.where(F.col("o_orderkey") % 7 == 0).select(F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey"))).alias("o_orderkey")))


@query("SELECT count(*) AS n, true AS small FROM orders")
def k2_batches(spark, sf_dir):
    path = logs.scratch(spark, "batches")
    logs.write_batches(table(spark, sf_dir, "orders"), path, 1000)
    most = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    return most.agg(F.sum("count").alias("n"), (F.max("count") <= 1000).alias("small"))


def _tsv(spark, sf_dir, **how) -> DataFrame:
    path = logs.scratch(spark, "tsv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderdate")
    logs.write_tsv(o, path, **how)
    return spark.read.text(path).select("value")


_TSV = "SELECT o_orderkey::VARCHAR || chr(9) || CASE WHEN o_orderkey % 5 = 0 THEN '{}' ELSE printf('%.{}f', o_totalprice) END || chr(9) || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END || chr(9) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS value FROM orders".format


@query(_TSV("", 4))
def k3_tsv(spark, sf_dir):
    return _tsv(spark, sf_dir)


@query(_TSV("0.00", 2))
def k5_tsv_nan_as_zero(spark, sf_dir):
    return _tsv(spark, sf_dir, digits=2, nan_as_zero=True)


@query("SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') AS p_start, strftime(o_orderdate + INTERVAL 1 MINUTE, '%d-%m-%Y %H:%M:%S') AS p_end FROM orders")
def k6_restamped(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", at("o_orderdate"), at(F.col("o_orderdate") + F.expr("INTERVAL 1 MINUTE"))).alias("p"))
    return logs.restamped(o, "p")


@query("SELECT l_linenumber::VARCHAR || ' 1:' || l_partkey || CASE WHEN l_returnflag <> 'R' THEN ' 2:' || l_suppkey ELSE '' END AS value FROM lineitem")
def k7_libsvm(spark, sf_dir):
    path = logs.scratch(spark, "libsvm")
    n = table(spark, sf_dir, "lineitem").withColumn("s", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))
    logs.write_libsvm(n, path, "l_linenumber", ["l_partkey", "s"])
    return spark.read.text(path).select("value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE round(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 7 <> 0")
def k8_database_rows(spark, sf_dir):
    """Rows inserted, replaced and deleted in a database, and read back in ranges."""
    path = logs.scratch(spark, "rows").removeprefix("file://")
    at = {"database": f"{path}.db", "timeout": 300}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    database.execute(at, "CREATE TABLE prices (o_orderkey BIGINT PRIMARY KEY, price DOUBLE, priority TEXT)")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("double").alias("price"), F.col("o_orderpriority").alias("priority"))
    database.change_rows(o, at, "prices", "insert")
    database.change_rows(o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(-1.0).alias("price"), F.lit(None).cast("string").alias("priority")), at, "prices", "replace", ["o_orderkey"])
    database.change_rows(o.where("o_orderkey % 7 = 0").select("o_orderkey"), at, "prices", "delete", ["o_orderkey"])
    most = database.execute(at, "SELECT max(o_orderkey) FROM prices")[0][0] or 0
    return database.read_query(spark, at, "SELECT * FROM prices", "o_orderkey long, price double, priority string", column="o_orderkey", low=0, high=most, parts=4)


def _image_folder(spark, sf_dir) -> str:
    """A file for one event of each day, named by its time as cameras do."""
    path = logs.scratch(spark, "images")
    first = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min_by("ts", F.col("event_id") * 7919 % 1000003).alias("ts"))
    logs.write_files(first.select(F.concat(F.lit("cam_"), F.date_format("ts", "yyyy_MM_dd_HH_mm_ss"), F.lit("_x.jpeg")).alias("name"), F.encode(F.col("day").cast("string"), "UTF-8").alias("content")), path)
    return path


_IMAGES = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 10::BIGINT AS length FROM (SELECT arg_min(ts, event_id * 7919 % 1000003) AS ts FROM events GROUP BY ts::DATE) WHERE hour(ts) < 3 AND (hour(ts) >= 1 OR hour(ts) = 0 AND minute(ts) >= 30)"


@query(_IMAGES)
def s3_image_list(spark, sf_dir):
    got = logs.image_files(spark, _image_folder(spark, sf_dir), 1, 3, lead=30)
    return got.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "length")


@query("SELECT count(*) AS n, true AS same FROM (SELECT arg_min(ts, event_id * 7919 % 1000003) AS ts FROM events GROUP BY ts::DATE) WHERE hour(ts) < 5")
def s4_kept_list(spark, sf_dir):
    """A folder's list, read again from where it is kept after the folder has grown."""
    path, kept = _image_folder(spark, sf_dir), logs.scratch(spark, "list")
    n = logs.listed(spark, path, kept, 0, 5).count()
    logs.write_files(spark.createDataFrame([("cam_2030_01_01_01_00_00_x.jpeg", b"later")], "name string, content binary"), path)
    return logs.listed(spark, path, kept, 0, 5).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == n).alias("same"))


@query("SELECT unnest([0, 1, 2])::BIGINT AS i, round(unnest([cos(0.3), sin(0.3), 0]), 6) + 0.0 AS c0, round(unnest([-sin(0.3) * cos(0.2), cos(0.3) * cos(0.2), sin(0.2)]), 6) + 0.0 AS c1, round(unnest([sin(0.3) * sin(0.2), -cos(0.3) * sin(0.2), cos(0.2)]), 6) + 0.0 AS c2")
def i3_rotation(spark, sf_dir):
    """The rotation between two sets of directions; the SQL has the one that made the second."""
    import math

    c, s, d, e = math.cos(0.3), math.sin(0.3), math.cos(0.2), math.sin(0.2)
    x, y, z = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double") * 3, F.col("l_discount").cast("double") * 100
    n = table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), z.alias("z"), (c * x - s * d * y + s * e * z).alias("u"), (s * x + c * d * y - c * e * z).alias("v"), (e * y + d * z).alias("w"))
    rows = I.rotation(n, ["x", "y", "z"], ["u", "v", "w"])
    return spark.createDataFrame([(i, *[round(v, 6) + 0.0 for v in row]) for i, row in enumerate(rows)], "i long, c0 double, c1 double, c2 double")


@query("SELECT s_nationkey::BIGINT AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, s_suppkey::DOUBLE AS key, s_acctbal::DOUBLE AS balance FROM supplier")
def s12_mat_files(spark, sf_dir):
    """A nation's suppliers as two variables of a MAT file, read back."""

    def packed(p):
        import pandas as pd

        p = p.sort_values("s_suppkey")
        return pd.DataFrame({"name": [f"nation{p['s_nationkey'].iat[0]}.mat"], "content": [matfiles.mat_bytes({"key": p["s_suppkey"].to_numpy(float), "balance": p["s_acctbal"].to_numpy(float)})]})

    path = logs.scratch(spark, "mat")
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    logs.write_files(s.groupBy("s_nationkey").applyInPandas(packed, "name string, content binary"), path)
    m = matfiles.mat(spark, path).withColumn("nation", F.regexp_extract("path", r"nation(\d+)", 1).cast("long"))
    return m.groupBy("nation", "i").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("key", "balance")])


@query()
def l18_components(spark, sf_dir):
    """The three directions in which the embeddings vary most."""
    _, parts, size = L.principal_components(table(spark, sf_dir, "embeddings"), "embedding", 3)
    return spark.createDataFrame([(i, j, round(float(size[i]), 5), round(float(v), 3)) for i, row in enumerate(parts) for j, v in enumerate(row)], "component long, position long, variance double, weight double")


# ---- streams ---------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, transform, mode: str) -> DataFrame:
    """What a stream of the events makes of them in two runs: the earlier half arrives, the stream ends, the rest arrives and
    it goes on from its checkpoint."""
    path = logs.scratch(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    half = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).first()[0]  # one row
    for part in (F.col("ts") < half, F.col("ts") >= half):
        e.where(part).write.mode("append").parquet(f"{path}/in")
        out = transform(spark.readStream.schema(e.schema).parquet(f"{path}/in")).writeStream.option("checkpointLocation", f"{path}/at").trigger(availableNow=True)
        if mode == "complete":
            out = out.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out"))
        else:
            out = out.outputMode("append" if mode == "timers" else mode).format("parquet").option("path", f"{path}/out")
        with timers.timer_state(spark) if mode == "timers" else nullcontext():
            out.start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')".format


@query(f"SELECT event_type, {_AT('''date_trunc('minute', ts)''')} AS start, round(avg(value), 6) + 0.0 AS v, count(*) AS n FROM events GROUP BY ALL")
def st1_minute_stream(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: stateful.minute_stream(s, ["event_type"], "ts", "value"), "complete")
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), r(F.col("v")).alias("v"), "n")


@query(f"WITH w AS (SELECT event_type, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(k) AS start, ts, value FROM (SELECT *, unnest([0, 3]) AS k FROM events)), v AS (SELECT * FROM w WHERE ts < start + INTERVAL 6 HOURS) SELECT event_type, {_AT('start')} AS start, round(avg(value), 6) + 0.0 AS v, count(*) AS n FROM v GROUP BY ALL")
def st_sliding_stream(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: stateful.sliding_stream(s, ["event_type"], "ts", "value", "6 hours", "3 hours"), "complete")
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), r(F.col("v")).alias("v"), "n")


@query(f"WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER o + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, {_AT('min(ts)')} AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM k GROUP BY user_id, k")
def st_session_stream(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: stateful.session_stream(s, ["user_id"], "ts", "value", "12 hours"), "complete")
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", r(F.col("total"), 4).alias("total"))


@query(f"WITH {E}, k AS (SELECT user_id, ts, list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS k FROM e) SELECT user_id, {_AT('ts')} AS ts, round(list_median(k), 6) + 0.0 AS v, len(k)::BIGINT AS n FROM k")
def st3_bounded_buffer(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: stateful.median_stream(s, "user_id", "ts", "value", 9), "append")
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("v")).alias("v"), "n")


@query(f"""WITH {E}, k AS (SELECT user_id, ts, list(value) OVER (PARTITION BY user_id ORDER BY t, value ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS k FROM e),
w AS (SELECT max(ts) - INTERVAL 10 MINUTES AS until FROM events)
SELECT user_id, {_AT('ts')} AS ts, round(list_median(k), 6) + 0.0 AS v, len(k)::BIGINT AS n FROM k, w WHERE (epoch_ms(ts) // 21600000 + 1) * 21600000 <= epoch_ms(until)""")
def st3_ordered_buffer(spark, sf_dir):
    """Medians of a user's last nine values, rows taken in order of time by pieces of six hours that the watermark has passed."""
    got = _streamed(spark, sf_dir, lambda s: timers.ordered_medians(s, "user_id", "ts", "value", 9, width="6 HOURS"), "timers")
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("v")).alias("v"), "n")


@query(f"""WITH RECURSIVE {E}, d AS (SELECT user_id, ts, value AS y, value - 3 AS a, value + 8 AS b, CASE WHEN event_id % 4 <> 0 THEN value * 1.1::DOUBLE END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM e),
k AS (SELECT user_id, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3, NULL::DOUBLE AS predicted FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, ts, 0.95::DOUBLE * s1 + 0.05::DOUBLE * abs(a - y), 0.95::DOUBLE * s2 + 0.05::DOUBLE * abs(b - y), 0.95::DOUBLE * s3 + 0.05::DOUBLE * coalesce(abs(c - y), (abs(a - y) + abs(b - y)) / 2), (w1 * a + w2 * b + coalesce(w3 * c, 0)) / (w1 + w2 + coalesce(w3, 0))
FROM (SELECT *, CASE WHEN q > 0 THEN exp(-o1 / q) ELSE (o1 = 0)::DOUBLE END AS w1, CASE WHEN q > 0 THEN exp(-o2 / q) ELSE (o2 = 0)::DOUBLE END AS w2, CASE WHEN q > 0 THEN exp(-o3 / q) ELSE (o3 = 0)::DOUBLE END AS w3
FROM (SELECT *, CASE WHEN c IS NULL THEN greatest(o1, o2) / 2 ELSE list_sort([o1, o2, o3])[2] END AS q
FROM (SELECT *, s1 - m AS o1, s2 - m AS o2, CASE WHEN c IS NOT NULL THEN s3 - m END AS o3
FROM (SELECT d.*, k.s1, k.s2, k.s3, least(k.s1, k.s2, CASE WHEN d.c IS NOT NULL THEN k.s3 END) AS m FROM k JOIN d ON k.user_id = d.user_id AND d.i = k.i + 1)))))
SELECT user_id, {_AT('ts')} AS ts, round(predicted, 6) + 0.0 AS predicted FROM k WHERE i > 0""")
def st6_forgetting_experts(spark, sf_dir):
    experts = {"low": F.col("value") - 3, "high": F.col("value") + 8, "some": F.when(F.col("event_id") % 4 != 0, F.col("value") * 1.1)}
    got = _streamed(spark, sf_dir, lambda s: stateful.forgetting_stream(s.withColumns(experts), "user_id", "ts", list(experts), "value", share=0.5), "append")
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("predicted")).alias("predicted"))


@query()
def st7_tracks(spark, sf_dir):
    """What three kinds of events do before a user's camera: things that move with the days, some frames unseen."""
    day, kind = F.floor(F.unix_timestamp("ts") / 86400), F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 400).otherwise(800)
    at = {"ts": F.timestamp_seconds(day * 86400), "x": kind + day % 100 * 2.0, "y": kind + F.col("value") / 100}
    got = _streamed(spark, sf_dir, lambda s: stateful.track_stream(s.withColumns(at), "user_id", "ts", "x", "y"), "append")
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "x", r(F.col("y")).alias("y"), "track")


@query(f"""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER o + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, {_AT('min(ts)')} AS start, {_AT('max(ts)')} AS last, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM k GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def st2_episodes(spark, sf_dir):
    """Episodes that end by a timer, with or without a further row of their user."""
    got = _streamed(spark, sf_dir, lambda s: timers.episode_stream(s, "user_id", "ts", "value", "12 HOURS"), "timers")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select("user_id", at("start"), at("last"), "n", r(F.col("total"), 4).alias("total"))


@query(f"SELECT event_id, {_AT('ts')} AS ts FROM events WHERE strftime(ts, '%H:%M') >= '20:30' OR strftime(ts, '%H:%M') < '05:15'")
def st9_hours_stream(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: stateful.within_hours(s, "ts", "20:30", "05:15"), "append")
    return got.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
