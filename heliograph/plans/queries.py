"""Every operator as a query over the driver's tables, beside the same result in DuckDB SQL.

Stand-ins: `events` are sensor series (key user_id, channels by event_type, time ts, reading value); `lineitem` rows are
samples (ghi from price, clear-sky value from quantity, day from the ship date); `part` sizes and prices are points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric as N
from ..functions import solar as S
from ..operators import aggregates as A
from ..operators import fields as I
from ..operators import learning as L
from ..operators import relations as R
from ..operators import series as T
from ..sources.logs import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, n: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c.cast("double"), n) + F.lit(0.0)


# ---- stand-ins ------------------------------------------------------------------------------------


def events(spark, sf_dir, kind: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    return e.select("event_id", "user_id", "event_type", "ts", T.micros("ts").alias("t"), "value")


def samples(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    return n.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.dayofyear("l_shipdate").alias("doy"), (F.col("l_extendedprice") / 100).alias("ghi"), (F.col("l_quantity") * 20).alias("clear"), (F.col("l_discount") * 800).alias("dni"), (F.col("l_tax") * 1000 + 10).alias("zenith"), F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 4).otherwise(2).alias("sun_flag"))


E = "e AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS t, value FROM events)"
SAMPLES = "s AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day, dayofyear(l_shipdate) AS doy, l_extendedprice / 100 AS ghi, l_quantity * 20 AS clear, l_discount * 800 AS dni, l_tax * 1000 + 10 AS zenith, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 4 ELSE 2 END AS sun_flag FROM lineitem)"
COS, SIN = "cos(radians({}))".format, "sin(radians({}))".format


# ---- filters and projections ------------------------------------------------------------------------


@query(f"WITH {SAMPLES} SELECT l_orderkey, l_linenumber, day, round(ghi, 6) + 0.0 AS ghi FROM s WHERE abs(ghi - clear) > 0.12 * clear AND clear > 100 AND sun_flag IN (1, 4)")
def f3_eligible_samples(spark, sf_dir):
    ok = (F.abs(F.col("ghi") - F.col("clear")) > 0.12 * F.col("clear")) & (F.col("clear") > 100) & F.col("sun_flag").isin(1, 4)
    return samples(spark, sf_dir).where(ok).select("l_orderkey", "l_linenumber", "day", r(F.col("ghi")).alias("ghi"))


@query(f"WITH {E}, d AS (SELECT *, lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e) SELECT event_id, user_id, value FROM d WHERE abs(value - p) < 40")
def f6_jump_filter(spark, sf_dir):
    p = F.lag("value", 1, 0.0).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, sf_dir).withColumn("p", p).where(F.abs(F.col("value") - F.col("p")) < 40).select("event_id", "user_id", "value")


@query(f"WITH {E} SELECT event_id, hour(ts)::BIGINT AS hour FROM e WHERE hour(ts) BETWEEN 12 AND 15")
def f7_noon_hours(spark, sf_dir):
    return events(spark, sf_dir).where(F.hour("ts").between(12, 15)).select("event_id", F.hour("ts").cast("long").alias("hour"))


@query(f"WITH {E}, d AS (SELECT *, date_trunc('day', ts)::DATE AS day FROM e), m AS (SELECT day, max(value) AS top FROM d GROUP BY day), b AS (SELECT day, min(ts) AS a, max(ts) AS z FROM d JOIN m USING (day) WHERE value >= 0.9 * top GROUP BY day) SELECT event_id, strftime(day, '%Y-%m-%d') AS day FROM d JOIN b USING (day) WHERE ts BETWEEN a AND z")
def f8_daylight_range(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    top = d.groupBy("day").agg(F.max("value").alias("top"))
    ends = d.join(top, "day").where(F.col("value") >= 0.9 * F.col("top")).groupBy("day").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return d.join(ends, "day").where(F.col("ts").between(F.col("a"), F.col("z"))).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"WITH {E}, d AS (SELECT date_trunc('day', ts)::DATE AS day, value, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY value) AS k FROM e) SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(value), 6) + 0.0 AS low FROM d WHERE k <= 5 GROUP BY day HAVING avg(value) < 1")
def f10_invalid_days(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("k", F.row_number().over(W.partitionBy("day").orderBy("value")))
    return d.where("k <= 5").groupBy("day").agg(F.avg("value").alias("low")).where("low < 1").select(F.date_format("day", "yyyy-MM-dd").alias("day"), r(F.col("low")).alias("low"))


@query(f"WITH {SAMPLES} SELECT sun_flag::BIGINT AS sun_flag, CASE sun_flag WHEN 1 THEN 0.0 WHEN 4 THEN 1.0 END::DOUBLE AS coefficient, count(*) AS n FROM s GROUP BY ALL")
def f13_sun_flag(spark, sf_dir):
    c = F.when(F.col("sun_flag") == 1, 0.0).when(F.col("sun_flag") == 4, 1.0)
    return samples(spark, sf_dir).groupBy(F.col("sun_flag").cast("long").alias("sun_flag"), c.alias("coefficient")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '1-URGENT')")
def f17_row_predicate(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.struct("o_orderstatus", "o_orderpriority") == F.struct(F.lit("F"), F.lit("1-URGENT"))).select("o_orderkey")


@query(f"""WITH {E}, q AS (SELECT min(t) AS a, max(t) AS z FROM e WHERE event_type = 'purchase'),
d AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt FROM e WHERE event_type = 'view')
SELECT event_id, t FROM d, q WHERE coalesce(nt, t) >= a AND coalesce(pt, t) <= z""")
def f9_crop_with_neighbours(spark, sf_dir):
    ends = events(spark, sf_dir, "purchase").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    beside = lambda w: {"nt": F.coalesce(F.lead("t").over(w), "t"), "pt": F.coalesce(F.lag("t").over(w), "t")}
    d = T.windowed(events(spark, sf_dir, "view"), ["user_id"], ["t"], 1, 1, beside)
    return d.crossJoin(F.broadcast(ends)).where("nt >= a AND pt <= z").select("event_id", "t")  # one row


# ---- joins -----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT o_orderkey, l_linenumber::BIGINT AS first_line, l_partkey FROM orders JOIN m ON o_orderkey = l_orderkey AND k = 1""")
def j1_first_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    hit, _ = R.first_match(o, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return hit.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("first_line"), "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j1_missing_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.first_match(o, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])[1].select(F.col("l_orderkey").alias("o_orderkey"))


@query(f"WITH {E}, m AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM e GROUP BY ALL) SELECT strftime(a.hour, '%Y-%m-%d %H:%M:%S') AS hour, round(a.v - b.v, 6) + 0.0 AS gap FROM m a JOIN m b USING (hour) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def j2_aligned_join(spark, sf_dir):
    m = lambda k: events(spark, sf_dir, k).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias(k))
    return m("click").join(m("view"), "hour").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), r(F.col("click") - F.col("view")).alias("gap"))


BRACKET = f"""{E}, q AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'), s AS (SELECT user_id, t, max(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT q.*, s.t AS t0, s.v AS v0 FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t),
x AS (SELECT b.*, s.t AS t1, s.v AS v1 FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t <= s.t)"""


def channels(spark, sf_dir):
    return events(spark, sf_dir, "click").select("event_id", "user_id", "t"), events(spark, sf_dir, "view").select("user_id", "t", "value")


@query(f"WITH {BRACKET} SELECT event_id, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN t0 ELSE t1 END AS t_near, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN v0 ELSE v1 END AS v_near FROM x")
def j3_nearest_join(spark, sf_dir):
    return T.nearest(*channels(spark, sf_dir), ["user_id"], "t", "value").select("event_id", "t_near", "v_near")


@query(f"WITH {BRACKET} SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) + 0.0 AS v FROM x")
def j4_interpolated_join(spark, sf_dir):
    return T.interpolate(*channels(spark, sf_dir), ["user_id"], "t", "value").select("event_id", r(F.col("v")).alias("v"))


@query(f"""WITH {BRACKET}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS j FROM s),
z AS (SELECT user_id, max(t) FILTER (k = 1) AS a1, max(v) FILTER (k = 1) AS y1, max(t) FILTER (k = 2) AS a2, max(v) FILTER (k = 2) AS y2, max(t) FILTER (j = 1) AS b1, max(v) FILTER (j = 1) AS z1, max(t) FILTER (j = 2) AS b2, max(v) FILTER (j = 2) AS z2 FROM n GROUP BY user_id)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN y1 + (y2 - y1) * (t - a1) / (a2 - a1) WHEN t1 IS NULL THEN z2 + (z1 - z2) * (t - b2) / (b1 - b2) WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) + 0.0 AS v FROM x LEFT JOIN z USING (user_id)""")
def j5_extrapolated_join(spark, sf_dir):
    return T.extrapolate(*channels(spark, sf_dir), ["user_id"], "t", "value").select("event_id", r(F.col("v"), 4).alias("v"))


@query(f"""WITH {E}, s AS (SELECT user_id, t, max(value) AS v FROM e GROUP BY ALL), q AS (SELECT event_id, user_id, t + 3600000000 AS t, value FROM e),
b AS (SELECT q.*, s.t AS t0, s.v AS v0 FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t),
x AS (SELECT b.*, s.t AS t1, s.v AS v1 FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.t <= s.t)
SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END - value, 6) + 0.0 AS error FROM x""")
def j7_persistence_error(spark, sf_dir):
    e = events(spark, sf_dir)
    q = T.ahead(e.select("event_id", "user_id", "t", "value"), e.select("user_id", "t", F.col("value").alias("x")), ["user_id"], "t", "x", 3_600_000_000)
    return q.select("event_id", r(F.col("v") - F.col("value")).alias("error"))


@query(f"WITH {E}, h AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM e GROUP BY ALL) SELECT strftime(a.h, '%Y-%m-%d %H:%M:%S') AS hour, round(a.v, 6) + 0.0 AS v, round(b.v, 6) + 0.0 AS two_before FROM h a JOIN h b ON b.h = a.h - INTERVAL 2 HOUR")
def j8_shifted_join(spark, sf_dir):
    h = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    b = h.select((F.col("h") + F.expr("INTERVAL 2 HOURS")).alias("h"), F.col("v").alias("b"))
    return h.join(b, "h").select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), r(F.col("v")).alias("v"), r(F.col("b")).alias("two_before"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j9_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    s = R.lookup(s, table(spark, sf_dir, "nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return R.lookup(s, table(spark, sf_dir, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


def _knn_sql(features: list[tuple[str, str]], where: str) -> str:
    distance = " + ".join(f"abs({x.format('q')}::DOUBLE - {x.format('x')}::DOUBLE)" for _, x in features)
    return f"q AS (SELECT * FROM part WHERE p_partkey % 100 = 0), d AS (SELECT q.p_partkey AS p_partkey, x.p_partkey AS near, {distance} AS distance, x.p_size AS y, row_number() OVER (PARTITION BY q.p_partkey ORDER BY {distance}, x.p_partkey) AS rank FROM q, part x WHERE {where})"


@query(f"WITH {_knn_sql([('price', '{}.p_retailprice'), ('size', '{}.p_size')], 'x.p_partkey <> q.p_partkey')} SELECT p_partkey, near, round(distance, 6) + 0.0 AS distance, rank FROM d WHERE rank <= 10")
def j10_nearest_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    got = R.nearest_neighbours(p.where("p_partkey % 100 = 0"), p.withColumn("near", F.col("p_partkey")), "p_partkey", "near", ["p_retailprice", "p_size"], 10, own=False)
    return got.select("p_partkey", "near", r(F.col("distance")).alias("distance"), "rank")


OUTLINE = [(0.0, 5.0), (20.0, 0.0), (50.0, 20.0), (40.0, 50.0), (15.0, 35.0)]


def _inside_sql(x: str, y: str) -> str:
    ends = zip(OUTLINE, [*OUTLINE[1:], OUTLINE[0]], strict=True)
    return "(" + " + ".join(f"CASE WHEN ({y1} > {y}) <> ({y2} > {y}) AND {x} < ({x2 - x1}) * ({y} - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in ends) + ") % 2 = 1"


@query(f"SELECT p_partkey, {_inside_sql('p_size::DOUBLE', '((p_partkey * 7) % 50)::DOUBLE')} AS inside FROM part")
def j11_point_in_polygon(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.in_polygon(F.col("p_size").cast("double"), (F.col("p_partkey") * 7 % 50).cast("double"), OUTLINE).alias("inside"))


@query("SELECT p_partkey FROM part WHERE (p_size - 25) * (p_size - 25) + (p_partkey * 7 % 50 - 25) * (p_partkey * 7 % 50 - 25) <= 225")
def j12_within_radius(spark, sf_dir):
    dx, dy = F.col("p_size") - 25, F.col("p_partkey") * 7 % 50 - 25
    return table(spark, sf_dir, "part").where(dx * dx + dy * dy <= 225).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 1009)::DOUBLE AS y FROM part),
d AS (SELECT q.id AS q, b.id AS near, sqrt((q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y)) AS d FROM p q JOIN p b ON q.id % 100 = 0 AND b.id <> q.id AND abs(q.x - b.x) <= 30 AND abs(q.y - b.y) <= 30),
m AS (SELECT q, arg_min(near, (d, near)) AS near, min(d) AS d FROM d WHERE d <= 30 GROUP BY q) SELECT id, near, round(d, 6) + 0.0 AS distance FROM p LEFT JOIN m ON id = q WHERE id % 100 = 0""")
def j13_nearest_cell(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).cast("double").alias("x"), (F.col("p_partkey") * 91 % 1009).cast("double").alias("y"))
    return R.nearest_cell(p.where("id % 100 = 0"), p.withColumn("near", F.col("id")), "id", "near", "x", "y", 30.0, own=False).select("id", "near", r(F.col("distance")).alias("distance"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j15_not_in_training(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"WITH {SAMPLES}, m AS (SELECT day, max(clear) AS top FROM s GROUP BY day) SELECT l_orderkey, l_linenumber, ghi / top AS share FROM s JOIN m USING (day)")
def j16_share_of_day_max(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.join(s.groupBy("day").agg(F.max("clear").alias("top")), "day").select("l_orderkey", "l_linenumber", (F.col("ghi") / F.col("top")).alias("share"))


# ---- aggregations ----------------------------------------------------------------------------------


@query(f"WITH {E} SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, round(avg(value), 6) + 0.0 AS v FROM e GROUP BY ALL")
def a1_minute_mean(spark, sf_dir):
    return T.minute_mean(events(spark, sf_dir), ["event_type"], "ts", "value").select("event_type", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), r(F.col("v")).alias("v"))


@query(f"WITH {E} SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, min(value) AS v FROM e GROUP BY ALL")
def a2_minute_min(spark, sf_dir):
    return T.minute_mean(events(spark, sf_dir), ["event_type"], "ts", "value", F.min).select("event_type", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "v")


@query(f"WITH {E} SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(var_samp(value), 4) + 0.0 AS variance, round(sum(value), 4) + 0.0 AS total FROM e GROUP BY ALL")
def a3_moments(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("sd"), r(F.var_samp(v), 4).alias("variance"), r(F.sum(v), 4).alias("total"))


@query(f"""WITH {E}, k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value IS NOT NULL),
p AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, p * n + 0.5)) AS pos FROM k, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.95]) AS p))
SELECT event_type, p, round(max(value) FILTER (i = floor(pos)) + (max(value) FILTER (i = ceil(pos)) - max(value) FILTER (i = floor(pos))) * max(pos - floor(pos)), 6) + 0.0 AS q FROM p GROUP BY event_type, p""")
def a5_hazen_quantiles(spark, sf_dir):
    return A.hazen_quantiles(events(spark, sf_dir), ["event_type"], "value", [0.05, 0.25, 0.5, 0.95]).select("event_type", "p", r(F.col("q")).alias("q"))


@query(f"WITH {SAMPLES} SELECT day, round(sum(exp(-0.01 * abs(ghi - clear)) * ghi) / sum(exp(-0.01 * abs(ghi - clear))), 6) + 0.0 AS v FROM s GROUP BY day")
def a6_softmax_mean(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("day").agg(r(A.softmax_mean(F.col("ghi"), F.abs(F.col("ghi") - F.col("clear")), 0.01)).alias("v"))


@query("SELECT 'l_returnflag' AS axis, l_returnflag AS level, sum(l_quantity) AS total FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, sum(l_quantity) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, sum(l_quantity) FROM lineitem GROUP BY ALL")
def a7_marginals(spark, sf_dir):
    return A.marginals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")


SIDE = 24  # of the square frames made from suppliers
FIELD = f"f AS (SELECT s_suppkey AS frame, x, y, (s_suppkey * 31 + x * x * 7 + y * 13 + x * y * s_suppkey) % 256 AS value FROM supplier, (SELECT unnest(range({SIDE})) AS x), (SELECT unnest(range({SIDE})) AS y))"


def field(spark, sf_dir) -> DataFrame:
    """A frame for each supplier: x, y in 0..23 and a grey value."""
    axis = F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(axis).alias("x")).select("frame", "x", F.explode(axis).alias("y"))
    return f.withColumn("value", (F.col("frame") * 31 + F.col("x") * F.col("x") * 7 + F.col("y") * 13 + F.col("x") * F.col("y") * F.col("frame")) % 256)


@query(f"WITH {FIELD} SELECT frame::BIGINT AS frame, CASE WHEN y < 12 THEN 'T' ELSE 'B' END || CASE WHEN x < 12 THEN 'L' ELSE 'R' END AS quadrant, round(100 * avg(CASE WHEN value > 140 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover FROM f GROUP BY ALL")
def a8_quadrant_cover(spark, sf_dir):
    return A.quadrant_cover(field(spark, sf_dir).withColumn("cloud", F.col("value") > 140), "frame", "x", "y", "cloud", (12, 12)).select("frame", "quadrant", r(F.col("cover")).alias("cover"))


@query(f"WITH {FIELD} SELECT frame::BIGINT AS frame, CASE WHEN y < 3 + 4 * (frame % 5) THEN 'T' ELSE 'B' END || CASE WHEN x < 5 + 3 * (frame % 5) THEN 'L' ELSE 'R' END AS quadrant, round(100 * avg(CASE WHEN value > 140 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover FROM f WHERE (x - 5 - 3 * (frame % 5)) * (x - 5 - 3 * (frame % 5)) + (y - 3 - 4 * (frame % 5)) * (y - 3 - 4 * (frame % 5)) <= 36 GROUP BY ALL")
def a8_circumsolar_cover(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("cloud", F.col("value") > 140).withColumn("sx", 5 + 3 * (F.col("frame") % 5)).withColumn("sy", 3 + 4 * (F.col("frame") % 5))
    return A.quadrant_cover(f, "frame", "x", "y", "cloud", (0, 0), ("sx", "sy"), 6).select("frame", "quadrant", r(F.col("cover")).alias("cover"))


@query(f"""WITH {E}, w AS (SELECT event_id, value, 50.0::DOUBLE AS ref, list(value - 50.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS k FROM e),
g AS (SELECT *, list_sort(k) AS s, len(k) AS n FROM w), h AS (SELECT *, CASE WHEN n >= 4 THEN list_sum(s[n - 1:n]) - list_sum(s[1:2]) END AS statistic FROM g)
SELECT event_id, round(statistic, 6) + 0.0 AS statistic, NOT abs(ref - value) / ref > 0.5 AND coalesce(statistic < 60, true) AS is_clear FROM h""")
def a9_clear_sky_test(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ref", F.lit(50.0))
    return T.clear_sky_test(e, ["user_id"], "t", "value", "ref", window=36_000_000_000, k=2, threshold=60, max_deviation=0.5, low=0).select("event_id", r(F.col("statistic")).alias("statistic"), "is_clear")


@query(f"WITH {E}, m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM e GROUP BY ALL) SELECT event_type, CASE WHEN hi = lo THEN 1 ELSE least(10, floor((value - lo) / (hi - lo) * 10) + 1) END::BIGINT AS bin, count(*) AS n FROM e JOIN m USING (event_type) GROUP BY ALL")
def a10_histogram(spark, sf_dir):
    return A.histogram(events(spark, sf_dir), ["event_type"], "value", 10)


@query("SELECT floor(l_quantity / 10)::BIGINT AS x, floor(l_discount * 50)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def a11_histogram_2d(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_discount") * 50).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT p_partkey, 100 * ceil(p_retailprice / 100) AS class FROM part), n AS (SELECT class, dense_rank() OVER (ORDER BY class) AS code FROM (SELECT class FROM c GROUP BY class HAVING count(*) >= 5)) SELECT p_partkey, code FROM c JOIN n USING (class)")
def a12_class_codes(spark, sf_dir):
    c = A.rare_classes_removed(table(spark, sf_dir, "part").select("p_partkey", N.ceil_bin(F.col("p_retailprice"), 100).alias("class")), "class", 5)
    codes = c.select("class").distinct().withColumn("code", F.dense_rank().over(W.orderBy("class")).cast("long"))  # a row a class
    return c.join(codes, "class").select("p_partkey", "code")


@query(f"""WITH {SAMPLES} SELECT sun_flag::BIGINT AS sun_flag, count(*) AS n, round(sqrt(avg((clear - ghi) ** 2)), 6) + 0.0 AS rmse, round(100 * sqrt(avg((clear - ghi) ** 2)) / avg(ghi), 6) + 0.0 AS rmse_percent, round(sqrt(avg((clear - ghi) ** 2)) / (max(ghi) - min(ghi)), 6) + 0.0 AS nrmse, round(avg(abs(clear - ghi)), 6) + 0.0 AS mae, round(avg(clear - ghi), 6) + 0.0 AS mbe,
round(sqrt(avg((clear - ghi) ** 2)) / stddev_pop(ghi), 6) + 0.0 AS rrmse, round(1 - sum((clear - ghi) ** 2) / (var_pop(ghi) * count(*)), 6) + 0.0 AS r2, round(1 - sum((clear - ghi) ** 2) / sum(ghi ** 2), 6) + 0.0 AS r2_uncentred FROM s GROUP BY sun_flag""")
def a15_error_metrics(spark, sf_dir):
    m = A.error_metrics(F.col("ghi"), F.col("clear"))
    return samples(spark, sf_dir).groupBy(F.col("sun_flag").cast("long").alias("sun_flag")).agg(*[(c if k == "n" else r(c)).alias(k) for k, c in m.items()])


@query(f"WITH {E}, c AS (SELECT user_id, sum(value) AS v FROM e WHERE event_type = 'click' GROUP BY ALL), w AS (SELECT user_id, sum(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL) SELECT count(c.v) AS n_a, count(w.v) AS n_b, CASE WHEN count(c.v) = count(w.v) THEN round(sqrt(avg((c.v - w.v) ** 2)), 6) + 0.0 END AS rmse FROM c FULL JOIN w USING (user_id)")
def a16_length_guard(spark, sf_dir):
    s = lambda k: events(spark, sf_dir, k).groupBy("user_id").agg(F.sum("value").alias("v"))
    p = A.paired(s("click"), s("view"), ["user_id"], "v")
    return p.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.when(F.count("a") == F.count("b"), r(A.error_metrics(F.col("a"), F.col("b"))["rmse"])).alias("rmse"))


@query("SELECT l_returnflag, round(sum(l_quantity), 4) + 0.0 AS total, round(avg(l_quantity), 6) + 0.0 AS mean, round(covar_pop(l_quantity, l_extendedprice), 2) + 0.0 AS cov, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS corr FROM lineitem GROUP BY ALL")
def a18_group_moments(spark, sf_dir):
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.sum(q), 4).alias("total"), r(F.avg(q)).alias("mean"), r(F.covar_pop(q, p), 2).alias("cov"), r(F.corr(q, p)).alias("corr"))


@query("SELECT l_returnflag AS actual, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL")
def a19_confusion(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("actual")).pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("actual", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""WITH d AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM d GROUP BY score)
SELECT score, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 9) + 0.0 AS tpr, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 9) + 0.0 AS fpr FROM g""")
def a19_roc(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return A.roc(d, "score", "y").select("score", r(F.col("tpr"), 9).alias("tpr"), r(F.col("fpr"), 9).alias("fpr"))


@query("""WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL), t AS (SELECT sum(c) AS t FROM j),
h AS (SELECT (SELECT -sum(c / t * ln(c / t)) FROM (SELECT sum(c) AS c FROM j GROUP BY x), t) AS h_x, (SELECT -sum(c / t * ln(c / t)) FROM (SELECT sum(c) AS c FROM j GROUP BY y), t) AS h_y, (SELECT -sum(c / t * ln(c / t)) FROM j, t) AS h_xy)
SELECT round(h_x, 6) + 0.0 AS h_x, round(h_y, 6) + 0.0 AS h_y, round(h_xy, 6) + 0.0 AS h_xy, round(h_x + h_y - h_xy, 6) + 0.0 AS mutual_information FROM h""")
def a20_information(spark, sf_dir):
    i = A.information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return i.select(*[r(F.col(c)).alias(c) for c in i.columns])


@query(f"WITH {FIELD} SELECT frame::BIGINT AS frame, floor(x / 6)::BIGINT AS tx, floor(y / 6)::BIGINT AS ty, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing, max(CASE WHEN value >= 20 THEN value END) - min(CASE WHEN value >= 20 THEN value END) AS spread FROM f GROUP BY ALL")
def a21_tile_stats(spark, sf_dir):
    v = F.when(F.col("value") >= 20, F.col("value"))
    return field(spark, sf_dir).groupBy("frame", F.floor(F.col("x") / 6).alias("tx"), F.floor(F.col("y") / 6).alias("ty")).agg(r(F.avg(v.isNull().cast("double"))).alias("missing"), (F.max(v) - F.min(v)).alias("spread"))


# ---- ordered analytics -----------------------------------------------------------------------------


def _over(df: DataFrame, before: int, after: int, columns) -> DataFrame:
    """columns(w) over the users' series."""
    return T.windowed(df, ["user_id"], ["t", "event_id"], before, after, columns)


OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id {})".format


@query(f"WITH {E} SELECT event_id, round(value - lag(value) {OVER('')}, 6) + 0.0 AS step FROM e")
def w1_difference(spark, sf_dir):
    return _over(events(spark, sf_dir), 1, 0, lambda w: {"step": r(F.col("value") - F.lag("value").over(w))}).select("event_id", "step")


def _despike_sql() -> str:
    out, last = f"WITH {E}, r0 AS (SELECT * FROM e)", "r0"
    for i in range(3):
        out += f""", m{i} AS (SELECT *, lag(value) {OVER('')} AS p, lead(value) {OVER('')} AS n FROM {last}), d{i} AS (SELECT *, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN abs(list_sort([p, value, n])[2] - value) END AS d FROM m{i}),
q{i} AS (SELECT *, avg(d) OVER (PARTITION BY user_id) + 2 * stddev_samp(d) OVER (PARTITION BY user_id) AS limit_ FROM d{i}), r{i + 1} AS (SELECT event_id, user_id, event_type, ts, t, value FROM q{i} WHERE coalesce(d <= limit_, true))"""
        last = f"r{i + 1}"
    return out + f" SELECT event_id, value FROM {last}"


@query(_despike_sql())
def w2_despike(spark, sf_dir):
    return T.despike(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", sigmas=2.0).select("event_id", "value")


@query(f"WITH {E}, k AS (SELECT event_id, list(value) {OVER('ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')} AS k FROM e) SELECT event_id, round(list_median(k), 6) + 0.0 AS v FROM k")
def w3_median_filter(spark, sf_dir):
    return _over(events(spark, sf_dir), 2, 2, lambda w: {"v": r(F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-2, 2)))}).select("event_id", "v")


@query(f"WITH {E} SELECT event_id, round(avg(value) {OVER('ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')}, 6) + 0.0 AS smooth, round(stddev_samp(value) {OVER('ROWS BETWEEN 60 PRECEDING AND CURRENT ROW')}, 5) + 0.0 AS sd61, round(avg(value) {OVER('ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING')}, 6) + 0.0 AS history FROM e")
def w4_moving_statistics(spark, sf_dir):
    v = F.col("value")
    moving = lambda w: {"smooth": r(F.avg(v).over(w.rowsBetween(-2, 2))), "sd61": r(F.stddev_samp(v).over(w.rowsBetween(-60, 0)), 5), "history": r(F.avg(v).over(w.rowsBetween(-50, -1)))}
    return _over(events(spark, sf_dir), 60, 2, moving).select("event_id", "smooth", "sd61", "history")


@query(f"WITH {FIELD}, a AS (SELECT frame, x, y, max(value) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM f) SELECT frame::BIGINT AS frame, x, y, max(value) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS value FROM a")
def w5_max_filter(spark, sf_dir):
    return I.box_filter(field(spark, sf_dir), "frame", 1, how=F.max)


@query(f"WITH {FIELD} SELECT a.frame::BIGINT AS frame, a.x, a.y, median(b.value)::DOUBLE AS value FROM f a JOIN f b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL")
def w5_median_filter(spark, sf_dir):
    return I.median_filter(field(spark, sf_dir), "frame", 1)


#: Of mask pixels p, the smallest pixel g.id that each reaches by touching sides or corners.
REACH = f"reach AS (SELECT frame, x, y, x * {SIDE} + y AS id FROM p UNION SELECT p.frame, p.x, p.y, reach.id FROM reach JOIN p ON p.frame = reach.frame AND abs(p.x - reach.x) <= 1 AND abs(p.y - reach.y) <= 1), g AS (SELECT frame, x, y, min(id) AS id FROM reach GROUP BY ALL)"


@query(f"""WITH RECURSIVE {FIELD}, c AS (SELECT *, CASE WHEN value > 215 THEN 1 ELSE 0 END AS c FROM f),
a AS (SELECT *, max(c) OVER (PARTITION BY frame, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS l, max(c) OVER (PARTITION BY frame, y ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS r, max(c) OVER (PARTITION BY frame, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS u, max(c) OVER (PARTITION BY frame, x ORDER BY y DESC ROWS UNBOUNDED PRECEDING) AS d FROM c),
b AS (SELECT *, max(l) OVER col + max(r) OVER col + max(u) OVER row_ + max(d) OVER row_ AS sides FROM a WINDOW col AS (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), row_ AS (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
p AS (SELECT frame, x, y FROM b WHERE value > 140 AND sides = 4), {REACH}, n AS (SELECT frame, id, count(*) AS n FROM g GROUP BY ALL), k AS (SELECT frame, sum(n) AS k FROM n WHERE n >= 10 GROUP BY ALL)
SELECT frame::BIGINT AS frame, round(CASE WHEN frame % 4 = 0 THEN 0 ELSE least(0.6::DOUBLE, coalesce(k, 0) / {SIDE * SIDE}) END, 6) + 0.0 AS factor FROM (SELECT DISTINCT frame FROM f) LEFT JOIN k USING (frame)""")
def w9_saturation_factor(spark, sf_dir):
    f = field(spark, sf_dir).withColumn("flag", F.when(F.col("frame") % 4 == 0, 4).otherwise(1))
    return I.saturation_factor(f, "frame", F.col("value") > 215, F.col("value") > 140, sun_flag="flag").select("frame", r(F.col("factor")).alias("factor"))


@query(f"WITH {E}, z AS (SELECT event_id, value < 5 AS low, lag(value < 5) {OVER('')} AS p, lead(value < 5) {OVER('')} AS n FROM e) SELECT event_id FROM z WHERE low AND NOT coalesce(p, true) AND NOT coalesce(n, true)")
def w11_brief_gaps(spark, sf_dir):
    low = F.col("value") < 5
    e = _over(events(spark, sf_dir), 1, 1, lambda w: {"low": low, "p": F.lag(low).over(w), "n": F.lead(low).over(w)})
    return e.where(F.col("low") & ~F.coalesce("p", F.lit(True)) & ~F.coalesce("n", F.lit(True))).select("event_id")


@query(f"WITH {E} SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {OVER('ROWS UNBOUNDED PRECEDING')}::BIGINT AS segment FROM e")
def w12_segment_labels(spark, sf_dir):
    starts = F.when(F.col("event_type") == "signup", 1).otherwise(0)
    return T.running(events(spark, sf_dir), ["user_id"], ["t", "event_id"], starts, "segment").select("event_id", "segment")


@query(f"WITH {E}, d AS (SELECT * FROM e WHERE value > 20), k AS (SELECT event_id, list(value) {OVER('ROWS BETWEEN 8 PRECEDING AND CURRENT ROW')} AS k, row_number() {OVER('')} AS i FROM d), g AS (SELECT event_id, CASE WHEN i < 9 THEN list_append(k, 50.0) ELSE k END AS k FROM k) SELECT event_id, CASE WHEN len(k) >= 3 THEN round(list_median(k), 6) + 0.0 END AS v FROM g")
def w13_running_median(spark, sf_dir):
    return T.running_median(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", F.col("value") > 20, seed=50.0).select("event_id", r(F.col("v")).alias("v"))


@query(f"WITH {E}, n AS (SELECT event_id, value, lag(value) {OVER('')} AS p, lead(value) {OVER('')} AS x FROM e) SELECT event_id, round(0.5 * (abs(value - coalesce(x, p)) + abs(value - coalesce(p, x))), 6) + 0.0 AS change FROM n")
def w16_neighbour_change(spark, sf_dir):
    v = F.col("value")
    e = _over(events(spark, sf_dir), 1, 1, lambda w: {"p": F.lag("value").over(w), "x": F.lead("value").over(w)})
    return e.select("event_id", r(0.5 * (F.abs(v - F.coalesce("x", "p")) + F.abs(v - F.coalesce("p", "x")))).alias("change"))


@query(f"""WITH RECURSIVE {E}, s AS (SELECT user_id, t, value AS u, CASE WHEN event_type <> 'view' THEN 3 * value END AS z, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS i FROM e),
k AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS t, 3.0::DOUBLE AS x1, -0.00053::DOUBLE AS x2, 1e-5::DOUBLE AS a, 0.0::DOUBLE AS b, 1e-9::DOUBLE AS d, NULL::DOUBLE AS l, 0.0::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, t, w1, w2, CASE WHEN z IS NULL THEN a ELSE (1 - g1 * l) * pa - g1 * l * l * pb END, CASE WHEN z IS NULL THEN b ELSE (1 - g1 * l) * pb - g1 * l * l * pd END, CASE WHEN z IS NULL THEN d ELSE (1 - g2 * l * l) * pd - g2 * l * pb END, CASE WHEN z IS NULL THEN l ELSE u END, w1 * u + w2 * u * u
FROM (SELECT *, CASE WHEN z IS NULL THEN x1 ELSE x1 + g1 * (z - x1 * u - x2 * u * u) END AS w1, CASE WHEN z IS NULL THEN x2 ELSE x2 + g2 * (z - x1 * u - x2 * u * u) END AS w2
FROM (SELECT *, (pa * l + pb * l * l) / v AS g1, (pb * l + pd * l * l) / v AS g2
FROM (SELECT *, l * (pa * l + pb * l * l) + l * l * (pb * l + pd * l * l) + 10 AS v
FROM (SELECT s.user_id, s.i, s.t, s.u, s.z, k.x1, k.x2, k.a, k.b, k.d, k.a + 1e-10 AS pa, k.b AS pb, k.d + 1e-10 AS pd, coalesce(k.l, s.u) AS l FROM k JOIN s ON k.user_id = s.user_id AND s.i = k.i + 1)))))
SELECT user_id, t, round(y, 6) + 0.0 AS y FROM k WHERE i > 0""")
def l14_kalman(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "t", F.col("value").alias("u"), F.when(F.col("event_type") != "view", 3 * F.col("value")).alias("z"))
    return T.kalman(e, ["user_id"], "t", "u", "z").select("user_id", "t", r(F.col("y")).alias("y"))


# ---- order, sets -----------------------------------------------------------------------------------


@query("WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT * FROM k WHERE rank <= 3")
def t2_top_per_group(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.alias("rank")).where("rank <= 3")


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY ALL")
def t3_arg_extremes(spark, sf_dir):
    by = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", by).alias("cheapest"), F.max_by("p_partkey", by).alias("dearest"))


@query("SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def t5_pareto_front(spark, sf_dir):
    return R.pareto_front(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, p_size + 1 + p_partkey % 5 AS b FROM part), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
p AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT b FROM e) UNION SELECT b, level + 1 FROM p JOIN e ON node = a) SELECT node::BIGINT AS node, max(level)::BIGINT AS level FROM p GROUP BY node""")
def t6_topological_levels(spark, sf_dir):
    spark.sparkContext.setCheckpointDir(scratch(spark, "levels"))
    e = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("a"), (F.col("p_size") + 1 + F.col("p_partkey") % 5).alias("b"))
    return R.topological_levels(e, "a", "b")


@query("SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'concat', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    cn, sn = c.select("c_nationkey"), s.select("s_nationkey")
    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("union", cn.union(sn).distinct()).union(count("intersect", cn.intersect(sn))).union(count("except", c.select("c_custkey").subtract(s.select("s_suppkey")))).union(count("concat", cn.union(sn)))


# ---- scalars and physics ---------------------------------------------------------------------------


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, dayofyear(o_orderdate)::BIGINT AS doy, (hour(o_orderdate) * 60 + minute(o_orderdate))::BIGINT AS minutes, abs(date_diff('day', make_date(year(o_orderdate)::INT, 7, 1), o_orderdate::DATE))::BIGINT AS from_july,
round((hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) / 86400, 9) + 0.0 AS day_share, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::BIGINT AS serial FROM orders""")
def date_functions(spark, sf_dir):
    d, y = F.col("o_orderdate"), F.year("o_orderdate")
    seconds = F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", y.cast("long").alias("y"), F.dayofyear(d).cast("long").alias("doy"), (F.hour(d) * 60 + F.minute(d)).cast("long").alias("minutes"), F.abs(F.datediff(F.to_date(d), F.make_date(y, F.lit(7), F.lit(1)))).cast("long").alias("from_july"), r(seconds / 86400, 9).alias("day_share"), (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).alias("leap"), F.datediff(F.to_date(d), F.lit("1899-12-30").cast("date")).cast("long").alias("serial"))


@query(f"""WITH {SAMPLES}, m AS (SELECT *, clear / 1000 AS x FROM s) SELECT l_orderkey, l_linenumber, round(1 - x, 6) + 0.0 AS linear, round(1 + (1 - exp(x)) / (exp(1) - 1), 6) + 0.0 AS exponential, round((1 - tanh(4 * (x - 0.5)) / tanh(2)) / 2, 6) + 0.0 AS sigmoid,
round(2 * tanh(6 * (ghi / clear - 0.3) / 0.6 - 3) - 1, 6) + 0.0 AS score, round(greatest(-6, least(6, log2(ghi / clear))), 6) + 0.0 AS ratio, greatest(1, least(8, floor((ghi - 0) / 1000 * 8) + 1))::BIGINT AS level FROM m""")
def response_curves(spark, sf_dir):
    g, c = F.col("ghi"), F.col("clear")
    a, b, d = N.cover_to_power(c / 1000)
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", r(a).alias("linear"), r(b).alias("exponential"), r(d).alias("sigmoid"), r(N.clear_score(g, c, 0.3, 0.9)).alias("score"), r(N.log_ratio(g, c)).alias("ratio"), N.quantise(g, 0, 1000, 8).cast("long").alias("level"))


HISTS = "h AS (SELECT l_linenumber AS k, [count(*) FILTER (l_quantity <= 10)::DOUBLE, count(*) FILTER (l_quantity > 10 AND l_quantity <= 20), count(*) FILTER (l_quantity > 20 AND l_quantity <= 35), count(*) FILTER (l_quantity > 35)] AS b FROM lineitem GROUP BY ALL)"


@query(f"""WITH {HISTS}, n AS (SELECT k, list_transform(b, lambda v: v / list_sum(b)) AS x FROM h), p AS (SELECT a.k AS k1, b.k AS k2, list_zip(a.x, b.x) AS z, a.x AS x, b.x AS y FROM n a JOIN n b ON a.k < b.k),
c AS (SELECT *, list_transform(generate_series(1, 4), lambda i: abs(list_sum(x[1:i]) - list_sum(y[1:i]))) AS gaps, list_transform(z, lambda v: v[1]::DOUBLE * ln(v[1] / ((v[1] + v[2]) / 2)) + v[2] * ln(v[2] / ((v[1] + v[2]) / 2))) AS jf FROM p)
SELECT k1::BIGINT AS k1, k2::BIGINT AS k2, round(list_sum(list_transform(z, lambda v: (v[1] - (v[1] + v[2]) / 2) ** 2 / ((v[1] + v[2]) / 2))), 9) + 0.0 AS chi_square, round(list_sum(jf), 9) + 0.0 AS jeffrey, round(list_sum(jf) / 2, 9) + 0.0 AS jensen_shannon, round(list_sum(list_transform(z, lambda v: v[1] * ln(v[1] / v[2]))), 9) + 0.0 AS kullback_leibler,
round(1 - list_sum(list_transform(z, lambda v: least(v[1], v[2]))) / list_sum(x), 9) + 0.0 AS intersection, round(list_sum(gaps), 9) + 0.0 AS match, round(list_max(gaps), 9) + 0.0 AS kolmogorov_smirnov, round(sqrt(greatest(0, 1 - list_sum(list_transform(z, lambda v: sqrt(v[1] * v[2]))) / sqrt(list_sum(x) * list_sum(y)))), 6) + 0.0 AS bhattacharyya FROM c""")
def histogram_distances(spark, sf_dir):
    q = F.col("l_quantity")
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("k")).agg(F.array(n(q <= 10), n((q > 10) & (q <= 20)), n((q > 20) & (q <= 35)), n(q > 35)).alias("b"))
    h = h.select("k", F.transform("b", lambda v: v / F.aggregate("b", F.lit(0.0), lambda s, x: s + x)).alias("x"))
    p = h.select(F.col("k").alias("k1"), "x").join(h.select(F.col("k").alias("k2"), F.col("x").alias("y")), F.col("k1") < F.col("k2"))  # seven histograms
    return p.select("k1", "k2", *[r(c, 6 if k == "bhattacharyya" else 9).alias(k) for k, c in N.histogram_distances(F.col("x"), F.col("y")).items()])


@query("""WITH v AS (SELECT p_partkey, [p_size / 25 - 0.5, p_retailprice / 2000, (p_partkey % 7) / 7 - 0.2] AS x FROM part), u AS (SELECT *, list_reverse_sort(x) AS u FROM v), k AS (SELECT p_partkey, x, u, unnest([1, 2, 3]) AS i FROM u),
l AS (SELECT p_partkey, x, i, (1 - list_sum(u[1:i])) / i AS shift FROM k WHERE u[i] + (1 - list_sum(u[1:i])) / i > 0), m AS (SELECT p_partkey, arg_max(x, i) AS x, arg_max(shift, i) AS s FROM l GROUP BY ALL)
SELECT p_partkey, round(greatest(x[1] + s, 0), 6) + 0.0 AS w1, round(greatest(x[2] + s, 0), 6) + 0.0 AS w2, round(greatest(x[3] + s, 0), 6) + 0.0 AS w3 FROM m""")
def st5_simplex_projection(spark, sf_dir):
    x = F.array(F.col("p_size") / 25 - 0.5, F.col("p_retailprice") / 2000, F.col("p_partkey") % 7 / 7 - 0.2)
    return table(spark, sf_dir, "part").select("p_partkey", N.simplex_projection(x).alias("w")).select("p_partkey", *[r(F.col("w")[i]).alias(f"w{i + 1}") for i in range(3)])


PLACE = {"latitude": 43.5, "longitude": 11.4, "altitude": 250.0}


def _sun(e: DataFrame) -> DataFrame:
    ts = F.col("ts")
    hours = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
    return S.with_sun_position(e, F.year(ts), F.dayofyear(ts), hours, PLACE["latitude"], PLACE["longitude"], S.pressure_of(PLACE["altitude"]))


_M = "({0}) - 360 * floor(({0}) / 360)".format
SUN = f"""{E}, u0 AS (SELECT *, year(ts) - 1900 AS yr, dayofyear(ts) AS doy, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS hr FROM e),
u1 AS (SELECT *, 365 * yr + floor((yr - 1) / 4) - 0.5 + doy AS mid, 100 * ((44331.514 - {PLACE['altitude']}) / 11880.516) ** (1 / 0.1902632) AS pres FROM u0),
u2 AS (SELECT *, mid / 36525 AS t0, (mid + hr / 24) AS ep, (mid + hr / 24) / 36525 AS t1 FROM u1),
u3 AS (SELECT *, (6 / 24 + 38 / 1440 + (45.836 + 8640184.542 * t0 + 0.0929 * t0 * t0) / 86400) AS g FROM u2),
u4 AS (SELECT *, {_M('360 * (g - floor(g)) + 360 * (1.0027379093 * hr / 24)')} AS gm, radians(23.452294 - 0.0130125 * t1 - 0.00000164 * t1 * t1 + 0.000000503 * t1 * t1 * t1) AS ob,
 281.22083 + 0.0000470684 * ep + 0.000453 * t1 * t1 + 0.000003 * t1 * t1 * t1 AS pg, {_M('358.47583 + 0.985600267 * ep - 0.00015 * t1 * t1 - 0.000003 * t1 * t1 * t1')} AS ma, 0.01675104 - 0.0000418 * t1 - 0.000000126 * t1 * t1 AS ec FROM u3),
k1 AS (SELECT *, ma + degrees(ec * sin(radians(ma))) AS x1 FROM u4), k2 AS (SELECT *, ma + degrees(ec * sin(radians(x1))) AS x2 FROM k1), k3 AS (SELECT *, ma + degrees(ec * sin(radians(x2))) AS x3 FROM k2),
k4 AS (SELECT *, ma + degrees(ec * sin(radians(x3))) AS x4 FROM k3), k5 AS (SELECT *, ma + degrees(ec * sin(radians(x4))) AS x5 FROM k4), k6 AS (SELECT *, ma + degrees(ec * sin(radians(x5))) AS ea FROM k5),
u5 AS (SELECT *, {_M('360 + gm + ' + str(PLACE['longitude']))} AS las, 2 * ({_M('degrees(atan(sqrt((1 + ec) / (1 - ec)) * tan(radians(ea) / 2)))')}) AS tr FROM k6),
u6 AS (SELECT *, radians({_M('pg + tr')} - 20 / 3600) AS el FROM u5),
u7 AS (SELECT *, asin(sin(ob) * sin(el)) AS de, las - degrees(atan2(cos(ob) * sin(el), cos(el))) AS ha FROM u6),
u8 AS (SELECT *, degrees(atan2(-sin(radians(ha)), {COS(PLACE['latitude'])} * tan(de) - {SIN(PLACE['latitude'])} * cos(radians(ha)))) AS az0, degrees(asin({COS(PLACE['latitude'])} * cos(de) * cos(radians(ha)) + {SIN(PLACE['latitude'])} * sin(de))) AS elevation, (180 + ha - CASE WHEN abs(ha) > 180 THEN 360 * sign(ha) ELSE 0 END) / 15 AS solar_time FROM u7),
u9 AS (SELECT *, CASE WHEN elevation > 5 AND elevation <= 85 THEN 58.1 / tan(radians(elevation)) - 0.07 / tan(radians(elevation)) ** 3 + 0.000086 / tan(radians(elevation)) ** 5 WHEN elevation > -0.575 AND elevation <= 5 THEN 1735 + elevation * (-518.2 + elevation * (103.4 + elevation * (-12.79 + elevation * 0.711))) WHEN elevation > -1 AND elevation <= -0.575 THEN -20.774 / tan(radians(elevation)) ELSE 0 END AS bend FROM u8),
sun AS (SELECT *, CASE WHEN az0 < 0 THEN az0 + 360 ELSE az0 END AS azimuth, elevation + bend * (283 / (273 + 12)) * pres / 101325 / 3600 AS apparent_elevation FROM u9)"""


@query(f"WITH {SUN} SELECT event_id, round(azimuth, 5) + 0.0 AS azimuth, round(elevation, 5) + 0.0 AS elevation, round(apparent_elevation, 5) + 0.0 AS apparent_elevation, round(solar_time, 5) + 0.0 AS solar_time FROM sun")
def sun_position(spark, sf_dir):
    return _sun(events(spark, sf_dir)).select("event_id", *[r(F.col(c), 5).alias(c) for c in ("azimuth", "elevation", "apparent_elevation", "solar_time")])


_EXTRA = "1367 * (1.00011 + 0.034221 * cos(2 * pi() * doy / 365) + 0.00128 * sin(2 * pi() * doy / 365) + 0.000719 * cos(4 * pi() * doy / 365) + 0.000077 * sin(4 * pi() * doy / 365))"
_A = PLACE["altitude"]


@query(f"""WITH {SUN}, z AS (SELECT *, 90 - apparent_elevation AS z, {COS('90 - apparent_elevation')} AS c, {_EXTRA} AS i0 FROM sun),
a AS (SELECT *, CASE WHEN z <= 90 THEN 1 / (c + 0.50572 * (6.07995 + (90 - z)) ** -1.6364) * pres / 101325 END AS am FROM z),
g AS (SELECT *, coalesce(greatest((0.0000509 * {_A} + 0.868) * i0 * c * exp(-(0.0000392 * {_A} + 0.0387) * am * (exp(-{_A} / 8000) + exp(-{_A} / 1250) * 2.5)) * exp(0.01 * am ** 1.8), 0), 0) AS ghi FROM a WHERE z IS NOT NULL),
d AS (SELECT *, coalesce(CASE WHEN c > 0 THEN least((0.664 + 0.163 / exp(-{_A} / 8000)) * i0 * exp(-0.09 * am * 2.5), ghi * (1 - (0.1 - 0.2 * exp(-3.5)) / (0.1 + 0.882 / exp(-{_A} / 8000))) / c) END, 0) AS dni FROM g)
SELECT event_id, round(ghi, 4) + 0.0 AS ghi, round(dni, 4) + 0.0 AS dni, round(ghi - dni * c, 4) + 0.0 AS dhi, round(CASE WHEN c > 0 THEN 1098 * c * exp(-0.059 / c) ELSE 0 END, 4) + 0.0 AS haurwitz FROM d""")
def clear_sky(spark, sf_dir):
    e = _sun(events(spark, sf_dir)).withColumn("z", 90 - F.col("apparent_elevation")).withColumn("doy", F.dayofyear("ts"))
    z = F.col("z")
    e = e.withColumn("am", S.absolute_airmass(S.relative_airmass(z), S.pressure_of(_A)))
    m = S.ineichen(F.col("doy"), z, F.col("am"), _A, 3.5)
    return e.select("event_id", *[r(c, 4).alias(k) for k, c in m.items()], r(S.haurwitz(z), 4).alias("haurwitz"))


_DF = {
    "erbs": "CASE WHEN kt > 0.8 THEN 0.165 WHEN kt > 0.22 THEN 0.9511 - 0.1604 * kt + 4.3888 * kt ** 2 - 16.638 * kt ** 3 + 12.336 * kt ** 4 ELSE 1 - 0.09 * kt END",
    "orgill_hollands": "CASE WHEN kt <= 0.35 THEN 1 - 0.249 * kt WHEN kt < 0.75 THEN 1.577 - 1.84 * kt ELSE 0.177 END",
    "reindl_1": "CASE WHEN kt <= 0.3 THEN 1.02 - 0.248 * kt WHEN kt < 0.78 THEN 1.45 - 1.67 * kt ELSE 0.147 END",
    "reindl_2": f"CASE WHEN kt <= 0.3 THEN 1.02 - 0.254 * kt + 0.0123 * {SIN('zenith')} WHEN kt < 0.78 THEN 1.4 - 1.749 * kt + 0.177 * {SIN('zenith')} ELSE 0.486 * kt - 0.182 * {SIN('zenith')} END",
}


DISC = f"""k AS (SELECT *, greatest(ghi / ({_EXTRA} * {COS('zenith')}), 0) AS kt, {_EXTRA} AS ea, 1370 * (1.00011 + 0.034221 * cos(2 * pi() * (doy - 1) / 365) + 0.00128 * sin(2 * pi() * (doy - 1) / 365) + 0.000719 * cos(4 * pi() * (doy - 1) / 365) + 0.000077 * sin(4 * pi() * (doy - 1) / 365)) AS i0, 1 / ({COS('least(zenith, 87)')} + 0.15 * (93.885 - least(zenith, 87)) ** -1.253) AS am FROM s),
q AS (SELECT *, greatest(ghi / (i0 * {COS('zenith')}), 0) AS k FROM k),
c AS (SELECT *, CASE WHEN k > 0.6 THEN -5.743 + 21.77 * k - 27.49 * k ** 2 + 11.56 * k ** 3 ELSE 0.512 - 1.56 * k + 2.286 * k ** 2 - 2.222 * k ** 3 END AS a, CASE WHEN k > 0.6 THEN 41.4 - 118.5 * k + 66.05 * k ** 2 + 31.9 * k ** 3 ELSE 0.37 + 0.962 * k END AS b, CASE WHEN k > 0.6 THEN -47.01 + 184.2 * k - 222 * k ** 2 + 73.81 * k ** 3 ELSE -0.28 + 0.932 * k - 2.048 * k ** 2 END AS c FROM q),
d AS (SELECT *, (0.866 - 0.122 * am + 0.0121 * am ** 2 - 0.000653 * am ** 3 + 0.000014 * am ** 4 - (a + b * exp(c * am))) * i0 AS dn FROM c)"""


@query(f"""WITH {SAMPLES}, {DISC} SELECT l_orderkey, l_linenumber, {', '.join(f"round(({x}) * ghi, 9) + 0.0 AS {m}_dhi, round((ghi - ({x}) * ghi) / {COS('zenith')}, 4) + 0.0 AS {m}_dni" for m, x in _DF.items())},
round((0.002 - 0.059 * kt + 0.994 * kt ** 2 - 5.205 * kt ** 3 + 15.307 * kt ** 4 - 10.627 * kt ** 5) * ea, 3) + 0.0 AS louche_dni, round(CASE WHEN zenith > 87 OR ghi < 1 OR dn < 0 THEN 0 ELSE dn END, 3) + 0.0 AS disc_dni FROM d""")
def decomposition(spark, sf_dir):
    g, z, d = F.col("ghi"), F.col("zenith"), F.col("doy")
    out = []
    for m in _DF:
        dhi, dni = S.split_global(m, g, z, d)
        out += [r(dhi, 9).alias(f"{m}_dhi"), r(dni, 4).alias(f"{m}_dni")]
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", *out, r(S.louche_dni(g, z, d), 3).alias("louche_dni"), r(S.disc_dni(g, z, d), 3).alias("disc_dni"))


_TILT, _FACE = 30.0, 180.0
_AOI = f"({COS('zenith')} * {COS(_TILT)} + {SIN(_TILT)} * {SIN('zenith')} * cos(radians(az - {_FACE})))"


@query(f"""WITH {SAMPLES}, a AS (SELECT *, 100 + l_linenumber * 20 AS az, ghi * 0.3 AS dhi, {_EXTRA} AS ea FROM s), b AS (SELECT *, {_AOI} AS c, degrees(acos(greatest(least({_AOI}, 1), -1))) AS aoi FROM a)
SELECT l_orderkey, l_linenumber, round(aoi, 6) + 0.0 AS aoi, round(dhi * (1 + {COS(_TILT)}) / 2, 6) + 0.0 AS isotropic, round(dhi * (1 + {COS(_TILT)}) / 2 + ghi * (0.012 * zenith - 0.04) * (1 - {COS(_TILT)}) / 2, 6) + 0.0 AS king,
round(dhi * (dni / ea * greatest(c, 0) / greatest({COS('zenith')}, 0.01745) + (1 - dni / ea) * 0.5 * (1 + {COS(_TILT)})), 6) + 0.0 AS hay_davies, round(ghi * 0.2 * (1 - {COS(_TILT)}) * 0.5, 6) + 0.0 AS ground,
round(CASE WHEN abs(aoi) > 90 OR 1 - 0.05 * (1 / {COS('aoi')} - 1) > 1 OR 1 - 0.05 * (1 / {COS('aoi')} - 1) < 0 THEN 0 ELSE 1 - 0.05 * (1 / {COS('aoi')} - 1) END, 6) + 0.0 AS ashrae,
round(CASE WHEN abs(aoi) > 90 OR (1 - exp(-{COS('aoi')} / 0.16)) / (1 - exp(-1 / 0.16)) < 0 THEN 0 ELSE (1 - exp(-{COS('aoi')} / 0.16)) / (1 - exp(-1 / 0.16)) END, 6) + 0.0 AS martin_ruiz FROM b""")
def transposition(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("az", 100 + F.col("l_linenumber") * 20).withColumn("dhi", F.col("ghi") * 0.3)
    z, az, dhi, g = F.col("zenith"), F.col("az"), F.col("dhi"), F.col("ghi")
    s = s.withColumn("aoi", S.incidence(_TILT, _FACE, z, az))
    return s.select("l_orderkey", "l_linenumber", r(F.col("aoi")).alias("aoi"), r(S.isotropic_diffuse(_TILT, dhi)).alias("isotropic"), r(S.king_diffuse(_TILT, dhi, g, z)).alias("king"), r(S.hay_davies_diffuse(_TILT, _FACE, dhi, F.col("dni"), S.extraterrestrial(F.col("doy")), z, az)).alias("hay_davies"), r(S.ground_diffuse(_TILT, g)).alias("ground"), r(S.iam_ashrae(0.05, F.col("aoi"))).alias("ashrae"), r(S.iam_martin_ruiz(0.16, F.col("aoi"))).alias("martin_ruiz"))


INVERTER = {"pac0": 250.0, "pdc0": 260.0, "vdc0": 40.0, "ps0": 2.0, "c0": -0.00004, "c1": -0.0004, "c2": 0.003, "c3": -0.01, "pnt": 0.3}
DIODE = {"a": 1.5, "il": 8.5, "i0": 1e-9, "rsh": 300.0, "rs": 0.35}


@query(f"""WITH {SAMPLES}, t AS (SELECT *, ghi * exp(-3.47 + -0.0594 * 2.0) + 20 AS module FROM s), c AS (SELECT *, module + ghi / 1000 * 3 AS cell FROM t),
d AS (SELECT *, CASE WHEN ghi > 0 THEN ghi / 1000 * (8.5 + 0.004 * (cell - 25)) ELSE 0 END AS il, 35.0 + l_linenumber AS v, 1.121 * (1 - 0.0002677 * (cell - 25)) AS eg FROM c),
p AS (SELECT *, 40.0 + l_linenumber - 40 AS dv, ghi * 0.25 AS pdc FROM d),
i AS (SELECT *, 260 * (1 - 0.0004 * dv) AS a, 2 * (1 + 0.003 * dv) AS b, -0.00004 * (1 - 0.01 * dv) AS cc FROM p),
o AS (SELECT *, (250 / (a - b) - cc * (a - b)) * (pdc - b) + cc * (pdc - b) * (pdc - b) AS ac FROM i)
SELECT l_orderkey, l_linenumber, round(module, 6) + 0.0 AS module, round(cell, 6) + 0.0 AS cell, round(il, 6) + 0.0 AS il, round(1e9 * CASE WHEN il = 0 THEN 0 ELSE 1e-9 * ((cell + 273.15) / 298.15) ** 3 * exp(1.121 / (8.617332478e-5 * 298.15) - eg / (8.617332478e-5 * (cell + 273.15))) END, 4) + 0.0 AS i0_nano, round(CASE WHEN ac > 250 THEN 250 WHEN ac < 2 THEN -0.3 ELSE ac END, 6) + 0.0 AS ac FROM o""")
def pv_system(spark, sf_dir):
    g = F.col("ghi")
    s = samples(spark, sf_dir)
    cell, module = S.cell_temperature(g, F.lit(2.0), F.lit(20.0), -3.47, -0.0594, 3.0)
    s = s.withColumn("module", module).withColumn("cell", cell)
    p = S.desoto(g, F.col("cell"), 0.004, DIODE)
    return s.select("l_orderkey", "l_linenumber", r(F.col("module")).alias("module"), r(F.col("cell")).alias("cell"), r(p["il"]).alias("il"), r(1e9 * p["i0"], 4).alias("i0_nano"), r(S.snl_inverter(40.0 + F.col("l_linenumber"), g * 0.25, INVERTER)).alias("ac"))


_BALANCE = "il - i0 * (exp((25 + (lo + hi) / 2 * 0.35) / a) - 1) - (25 + (lo + hi) / 2 * 0.35) / rsh > (lo + hi) / 2"  # the current is above the middle


@query(f"""WITH RECURSIVE {SAMPLES}, d AS (SELECT l_orderkey, l_linenumber, ghi / 1000 * (8.5 + 0.004 * 10) AS il, 1e-9 * (308.15 / 298.15::DOUBLE) ** 3 * exp(1.121 / (8.617332478e-5 * 298.15) - 1.121 * (1 - 0.0002677 * 10) / (8.617332478e-5 * 308.15)) AS i0, 1.5 * 308.15 / 298.15::DOUBLE AS a, 300 * 1000 / ghi AS rsh FROM s),
n AS (SELECT *, -10.0::DOUBLE AS lo, il AS hi, 0 AS k FROM d UNION ALL SELECT l_orderkey, l_linenumber, il, i0, a, rsh, CASE WHEN {_BALANCE} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_BALANCE} THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM n WHERE k < 50) SELECT l_orderkey, l_linenumber, round((lo + hi) / 2, 4) + 0.0 AS current FROM n WHERE k = 50""")
def diode_curve(spark, sf_dir):
    s = samples(spark, sf_dir)
    p = S.desoto(F.col("ghi"), F.lit(35.0), 0.004, DIODE)
    return s.select("l_orderkey", "l_linenumber", r(S.diode_current(F.lit(25.0), p), 4).alias("current"))


@query(f"""WITH {SAMPLES}, c AS (SELECT *, 1 - ghi / 2000 AS d, cos((doy - 173 - 365 * floor((doy - 173) / 365)) / 183 * pi()) AS m FROM s)
SELECT l_orderkey, l_linenumber, round(ghi - dni * {COS('zenith')} * CASE sun_flag WHEN 1 THEN 0 WHEN 4 THEN 1 END, 6) + 0.0 AS diffuse, round(0.9 * {COS('zenith')} * dni + 1.14 * ghi * 0.3, 6) + 0.0 AS flat, round({COS('zenith')} * dni + 0.78 * ghi * 0.3, 6) + 0.0 AS tilted,
round(greatest(0.5 * (1 - d), 1 - (0.8535 + 0.1342 * m) * d - (0.2364 + 0.1374 * m) * d * d - (0.0227 - 0.2178 * m) * d * d * d), 9) + 0.0 AS clear_power FROM c""")
def irradiance_sensor(spark, sf_dir):
    g, z, dni = F.col("ghi"), F.col("zenith"), F.col("dni")
    return samples(spark, sf_dir).select("l_orderkey", "l_linenumber", r(S.diffuse_sensor(g, dni, z, F.col("sun_flag"))).alias("diffuse"), r(S.reconstruct(dni, g * 0.3, z)).alias("flat"), r(S.reconstruct(dni, g * 0.3, z, True)).alias("tilted"), r(S.clear_power_curve(F.col("doy"), g / 2000), 9).alias("clear_power"))


# ---- fields ----------------------------------------------------------------------------------------


@query(f"""WITH {FIELD}, m AS (SELECT *, (x - 12.5 - 0.01 * (y - 11.5)) / (1.001 - 0.01 * 0.02) AS u, (1.001 * (y - 11.5) - 0.02 * (x - 12.5)) / (1.001 - 0.01 * 0.02) AS v FROM f), k AS (SELECT *, sqrt(u * u + v * v) AS rr FROM m), z AS (SELECT *, -10 + 0.02 * rr * rr - 0.0001 * rr * rr * rr AS w FROM k)
SELECT frame::BIGINT AS frame, x, y, round(u / sqrt(u * u + v * v + w * w), 6) + 0.0 AS rx, round(v / sqrt(u * u + v * v + w * w), 6) + 0.0 AS ry, round(w / sqrt(u * u + v * v + w * w), 6) + 0.0 AS rz FROM z""")
def i1_camera_ray(spark, sf_dir):
    ray = N.camera_ray(F.col("x").cast("double"), F.col("y").cast("double"), (12.5, 11.5), (1.001, 0.01, 0.02), [-10.0, 0.0, 0.02, -0.0001])
    return field(spark, sf_dir).select("frame", "x", "y", *[r(c).alias(n) for c, n in zip(ray, ("rx", "ry", "rz"), strict=True)])


@query(f"WITH {FIELD} SELECT frame::BIGINT AS frame, floor(x / 4)::BIGINT AS x, floor(y / 4)::BIGINT AS y, round(avg(value), 6) + 0.0 AS value FROM f GROUP BY ALL")
def i4_downscale(spark, sf_dir):
    return I.downscale(field(spark, sf_dir), "frame", 4).withColumn("value", r(F.col("value")))


@query(f"WITH {FIELD} SELECT a.frame::BIGINT AS frame, a.x, a.y, b.value::BIGINT AS value FROM f a LEFT JOIN f b ON a.frame = b.frame AND a.x = b.x + 2 AND a.y = b.y - 1")
def i5_shift(spark, sf_dir):
    return I.shift(field(spark, sf_dir), "frame", 2, -1)


@query(f"""WITH {FIELD}, g AS (SELECT frame, x + 1 AS x, y - 2 AS y, value FROM f), c AS (SELECT unnest(range(-2, 3)) AS dx), d AS (SELECT dx, unnest(range(-2, 3)) AS dy FROM c),
m AS (SELECT f.frame, dx, dy, avg((g.value - f.value) * (g.value - f.value)) AS error FROM f, d, g WHERE g.frame = f.frame AND g.x = f.x + dx AND g.y = f.y + dy GROUP BY ALL)
SELECT frame::BIGINT AS frame, arg_min(dx, (error, dx, dy)) AS dx, arg_min(dy, (error, dx, dy)) AS dy, min(error) AS error FROM m GROUP BY frame""")
def i6_motion(spark, sf_dir):
    f = field(spark, sf_dir)
    return I.best_motion(f, f.withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") - 2), "frame", 2)


@query(f"""WITH {FIELD}, h AS (SELECT frame, value, count(*)::DOUBLE AS n FROM f GROUP BY ALL), c AS (SELECT frame, value AS l, sum(n) OVER w AS n0, sum(n * value) OVER w AS s0, sum(n) OVER (PARTITION BY frame) AS nt, sum(n * value) OVER (PARTITION BY frame) AS st FROM h WINDOW w AS (PARTITION BY frame ORDER BY value ROWS UNBOUNDED PRECEDING)),
b AS (SELECT frame, l, round(n0 * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)) / (nt * nt), 9) AS b FROM c WHERE nt > n0) SELECT frame::BIGINT AS frame, arg_min(l, (-b, l))::DOUBLE AS threshold FROM b GROUP BY frame""")
def i9_otsu(spark, sf_dir):
    h = field(spark, sf_dir).groupBy("frame", "value").agg(F.count(F.lit(1)).alias("n"))
    return I.otsu(h, "frame", "value", "n")


# ---- learning --------------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem GROUP BY ALL")
def l1_line(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.regr_slope(y, x), 5).alias("slope"), r(F.regr_intercept(y, x), 4).alias("intercept"), r(F.regr_r2(y, x)).alias("r2"))


def _residual_sql(source: str, columns: list[str], target: str) -> str:
    """CTEs that end in r(y, e): the target and its residual, by centring and making the columns orthogonal one after another."""
    names = [f"x{i}" for i in range(len(columns))]
    steps = [f"r0 AS (SELECT y, y - avg(y) OVER () AS e, {', '.join(f'{n} - avg({n}) OVER () AS {n}' for n in names)} FROM (SELECT {target}::DOUBLE AS y, {', '.join(f'({c})::DOUBLE AS {n}' for c, n in zip(columns, names, strict=True))} FROM {source}))"]
    for k, z in enumerate(names):
        less = lambda c: f"{c} - {z} * (sum({c} * {z}) OVER () / sum({z} * {z}) OVER ()) AS {c}"  # noqa: E731, B023
        steps.append(f"r{k + 1} AS (SELECT y, {', '.join(less(c) for c in ('e', *names[k + 1 :]))} FROM r{k})")
    return ", ".join(steps) + f", r AS (SELECT y, e FROM r{len(names)})"


@query(f"""WITH {_residual_sql("lineitem", ["l_quantity", "l_discount", "l_tax", "l_quantity * l_discount", "l_quantity * l_tax", "l_discount * l_tax"], "l_extendedprice")}, d AS (SELECT y, greatest(y - e, 0) - y AS e FROM r)
SELECT count(*) AS n, round(sqrt(avg(e * e)), 2) + 0.0 AS rmse, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 4) + 0.0 AS r2 FROM d""")
def l1_interactions(spark, sf_dir):
    d, x = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]
    y = L.linear_prediction(L.least_squares(d, x, "l_extendedprice"), x)
    m = A.error_metrics(F.col("l_extendedprice"), y)
    return d.agg(m["n"].alias("n"), r(m["rmse"], 2).alias("rmse"), r(m["r2"], 4).alias("r2"))


@query("SELECT p_partkey, round((p_size * p_size)::DOUBLE, 6) + 0.0 AS p_size_sq, round(sqrt(p_size), 6) + 0.0 AS p_size_root FROM part")
def l3_powers(spark, sf_dir):
    return L.with_powers(table(spark, sf_dir, "part"), ["p_size"]).select("p_partkey", r(F.col("p_size_sq")).alias("p_size_sq"), r(F.col("p_size_root")).alias("p_size_root"))


@query(f"WITH {_knn_sql([('price', '{}.p_retailprice'), ('class', '({}.p_partkey * 7 % 50)')], 'x.p_partkey % 100 <> 0')} SELECT p_partkey, round(CASE WHEN sum(distance) > 0 THEN sum(distance * y) / sum(distance) ELSE avg(y) END, 5) + 0.0 AS y FROM d WHERE rank <= 10 GROUP BY p_partkey")
def l4_neighbour_regression(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("class", F.col("p_partkey") * 7 % 50)
    q, x = p.where("p_partkey % 100 = 0"), p.where("p_partkey % 100 <> 0").withColumn("near", F.col("p_partkey"))  # to be estimated, and known
    return L.neighbour_regression(q, x, "p_partkey", "near", ["p_retailprice", "class"], "p_size").select("p_partkey", r(F.col("y"), 5).alias("y"))


@query("WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, i <= floor(0.75 * n) AS is_train FROM k")
def l8_head_split(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey").repartitionByRange("p_partkey").withColumn("_r", F.spark_partition_id())
    sizes = p.groupBy("_r").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.select("_r", F.coalesce(F.sum("c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(W.partitionBy()).alias("n"))  # a row a range
    i = F.row_number().over(W.partitionBy("_r").orderBy("p_partkey"))
    return p.withColumn("i", i).join(F.broadcast(sizes), "_r").select("p_partkey", (F.col("i") + F.col("b") <= F.floor(0.75 * F.col("n"))).alias("is_train"))


def _strata_sql() -> str:
    b = "CASE WHEN y < 100 THEN 0 WHEN y < 200 THEN 1 WHEN y < 300 THEN 2 WHEN y < 400 THEN 3 WHEN y < 600 THEN 4 END"
    return f"""WITH s AS (SELECT o_orderkey, o_totalprice / 800 AS y FROM orders), n AS (SELECT count(*) AS n FROM s), k AS (SELECT o_orderkey, {b} AS b, row_number() OVER (PARTITION BY {b} ORDER BY md5('1|' || o_orderkey), o_orderkey) AS i, count(*) OVER (PARTITION BY {b}) AS t FROM s)
SELECT o_orderkey, coalesce(i <= CASE b WHEN 0 THEN 2000 // 5 WHEN 1 THEN 2000 // 5 WHEN 2 THEN least(2000 // 5, floor(0.7 * t)) WHEN 3 THEN least(2000 // 5, floor(0.7 * t)) WHEN 4 THEN least(2000 // 10, floor(0.7 * t)) END, false) AS is_train FROM k"""


@query(_strata_sql())
def l9_stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 800).alias("y"))
    return L.stratified_train(o, "o_orderkey", "y", 2000).select("o_orderkey", "is_train")


@query("""WITH d AS (SELECT l_quantity * 20 AS x, l_extendedprice AS y FROM lineitem), w AS (SELECT min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS gs, regr_intercept(y, x) AS gi FROM d),
g AS (SELECT least(20, floor((x - lo) / (hi - lo) * 20) + 1)::BIGINT AS bin, lo, hi, gs, gi, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM d, w GROUP BY ALL)
SELECT bin, round(CASE WHEN lo + (hi - lo) * bin / 20 > 300 AND s > 0 THEN s ELSE gs END, 4) + 0.0 AS slope, round(CASE WHEN lo + (hi - lo) * bin / 20 > 300 AND s > 0 THEN i ELSE gi END, 2) + 0.0 AS intercept, n FROM g""")
def l11_recalibration(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 20).alias("x"), F.col("l_extendedprice").alias("y"))
    return L.recalibration(d, "x", "y").select("bin", r(F.col("slope"), 4).alias("slope"), r(F.col("intercept"), 2).alias("intercept"), "n")


_CHOICE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_SUBSET = lambda m: _residual_sql("lineitem", [c for i, c in enumerate(_CHOICE) if m >> i & 1], "l_extendedprice")
_STEP = lambda k: f"g{k + 1} AS (SELECT arg_min(t.m, t.sse) AS m, min(t.sse) AS sse, g.m AS before FROM g{k} g JOIN t ON (t.m & g.m) = g.m AND bit_count(t.m) = {k + 1} GROUP BY g.m, g.sse HAVING (SELECT count(*) FROM lineitem) * (ln(g.sse) - ln(min(t.sse))) >= 0.708)"


@query(f"""WITH t AS ({" UNION ALL ".join(f"SELECT {m} AS m, (WITH {_SUBSET(m)} SELECT sum(e * e) FROM r) AS sse" for m in range(1, 1 << len(_CHOICE)))}), g0 AS (SELECT 0 AS m, (SELECT var_pop(l_extendedprice) * count(*) FROM lineitem) AS sse), {", ".join(map(_STEP, range(len(_CHOICE))))}
{" UNION ALL ".join(f"SELECT {k}::BIGINT AS step, {_CHOICE!r}[log2(m - before)::INT + 1] AS feature FROM g{k + 1}" for k in range(len(_CHOICE)))}""")
def l7_forward_selection(spark, sf_dir):
    got = L.forward_selection(table(spark, sf_dir, "lineitem"), _CHOICE, "l_extendedprice")
    return spark.createDataFrame([(i, c) for i, c in enumerate(got)], "step long, feature string")


@query()
def l5_kernel_regression(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), F.col("l_extendedprice").cast("double").alias("y"))
    fitted = L.kernel_regression(d, ["q", "d"], "y", gamma=2.0, width=64)(d)
    m = A.error_metrics(F.col("y"), F.col("y_hat"))
    return fitted.agg(m["n"].alias("n"), r(m["rmse"], 1).alias("rmse"), r(m["r2"], 3).alias("r2"))


@query("WITH m AS (SELECT avg(p_size) AS mean, stddev_samp(p_size) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round((p_size - mean) / sd, 6) + 0.0 AS z, round(-1 + 2 * (p_retailprice - lo) / (hi - lo), 6) + 0.0 AS mapped, p_brand = 'Brand#11' AS is_first_brand FROM part, m")
def l18_standardised(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = p.agg(F.avg("p_size").alias("mean"), F.stddev_samp("p_size").alias("sd"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    p = p.crossJoin(F.broadcast(m))  # one row
    return p.select("p_partkey", r((F.col("p_size") - F.col("mean")) / F.col("sd")).alias("z"), r(N.linear_map(F.col("p_retailprice"), F.col("lo"), F.col("hi"), -1.0, 1.0)).alias("mapped"), (F.col("p_brand") == "Brand#11").alias("is_first_brand"))


# ---- delayed scoring, as on streams ----------------------------------------------------------------


@query(f"WITH {E}, h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM e GROUP BY ALL) SELECT strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(p.v - t.v, 6) + 0.0 AS error FROM h p JOIN h t ON t.ts = p.ts + INTERVAL 1 HOUR")
def st4_delayed_scores(spark, sf_dir):
    from ..streaming.stateful import delayed_scores

    h = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("v"))
    s = delayed_scores(h.withColumnRenamed("v", "predicted"), h.withColumnRenamed("v", "actual"), [], "1 HOUR")
    return s.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("error")).alias("error"))
