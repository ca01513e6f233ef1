"""Readers, writers, streams and edge cases on small rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.functions import numeric as N
from heliograph.functions import solar as S
from heliograph.operators import fields, learning, relations, series
from heliograph.sources import logs
from heliograph.streaming import stateful


def test_bracket_prefers_larger_of_equal_times_and_crosses_buckets(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 500, 7.0), (2, 5, None)], "k long, t long, v double")
    q = spark.createDataFrame([(1, 0), (1, 250), (1, 900), (2, 5), (3, 1), (None, 1)], "k long, t long")
    got = {(r["k"], r["t"]): r["v"] for r in series.interpolate(q, s, ["k"], "t", "v", bucket=100).collect()}
    assert got == {(1, 0): 2.0, (1, 250): 4.5, (1, 900): None, (2, 5): None, (3, 1): None, (None, 1): None}
    near = {(r["k"], r["t"]): r["v_near"] for r in series.nearest(q, s, ["k"], "t", "v", bucket=100).collect()}
    assert near[(1, 250)] == 2.0 and near[(1, 900)] == 7.0 and near[(3, 1)] is None
    ends = {(r["k"], r["t"]): r["v"] for r in series.extrapolate(q, s, ["k"], "t", "v", bucket=100).collect()}
    assert ends[(1, 900)] == pytest.approx(11.0)


def test_bracket_of_empty_tables(spark):
    q, s = spark.createDataFrame([], "k long, t long"), spark.createDataFrame([], "k long, t long, v double")
    assert series.interpolate(q, s, ["k"], "t", "v").count() == 0


def test_despike_drops_a_spike_and_keeps_ends(spark):
    rows = [(1, i, 1000.0 if i == 50 else float(i % 3)) for i in range(100)]
    got = series.despike(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], ["t"], "v")
    assert got.where("v > 100").count() == 0 and got.where("t in (0, 99)").count() == 2


def test_diode_current_solves_its_equation(spark):
    ref = {"a": 1.5, "il": 8.5, "i0": 1e-9, "rsh": 300.0, "rs": 0.35}
    d = spark.createDataFrame([(g, v) for g in (200.0, 1000.0) for v in (0.0, 20.0, 30.0)], "g double, v double")
    p = S.desoto(F.col("g"), F.lit(25.0), 0.004, ref)
    for r in d.select("v", *[c.alias(k) for k, c in p.items()], S.diode_current(F.col("v"), p).alias("i")).collect():
        e = r["il"] - r["i0"] * (math.exp((r["v"] + r["i"] * r["rs"]) / r["nnsvth"]) - 1) - (r["v"] + r["i"] * r["rs"]) / r["rsh"] - r["i"]
        assert abs(e) < 1e-6


def test_sun_is_high_at_noon_in_june(spark):
    d = spark.createDataFrame([(2016, 173, 11.25), (2016, 173, 23.25)], "y int, doy int, h double")
    a, b = S.with_sun_position(d, F.col("y"), F.col("doy"), F.col("h"), 43.5, 11.4).orderBy("h").collect()
    assert abs(a["elevation"] - (90 - 43.5 + 23.43)) < 0.5 and b["elevation"] < -20 and abs(a["azimuth"] - 180) < 5


def test_pressure_and_altitude_are_inverse(spark):
    d = spark.createDataFrame([(0.0,), (500.0,)], "a double").select("a", S.altitude_of(S.pressure_of(F.col("a"))).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1 for r in d)


def test_simplex_and_quadratic_form(spark):
    d = spark.createDataFrame([([0.5, 0.1, 2.0], [0.4, 0.4, 0.2])], "x array<double>, y array<double>")
    r = d.select(N.simplex_projection(F.col("x")).alias("w"), N.quadratic_form(F.col("x"), F.col("y"), np.eye(3).tolist()).alias("d"), N.minkowski(F.col("x"), F.col("y"), 2).alias("e")).first()
    assert sum(r["w"]) == pytest.approx(1) and np.allclose(r["w"], stateful.onto_simplex(np.array([0.5, 0.1, 2.0])))
    assert r["d"] == pytest.approx(r["e"])


def test_kalman_follows_and_predicts(spark):
    rows = [(1, i, float(i % 50), None if i % 5 == 0 else 2.5 * (i % 50)) for i in range(300)]
    got = series.kalman(spark.createDataFrame(rows, "k long, t long, u double, z double"), ["k"], "t", "u", "z", p0=(1.0, 1e-6)).orderBy("t").collect()
    assert len(got) == 300 and abs(got[-1]["y"] - 2.5 * 49) < 10


def test_rotation_is_found(spark):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q = q * np.sign(np.linalg.det(q))
    x = rng.normal(size=(50, 3))
    d = spark.createDataFrame([tuple(map(float, [*a, *(q @ a)])) for a in x], "a double, b double, c double, d double, e double, f double")
    assert np.allclose(fields.rotation(d, ["a", "b", "c"], ["d", "e", "f"]), q)


def test_cycle_is_refused(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError):
        relations.topological_levels(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), "a", "b")


def test_regressions(spark):
    d = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), "id")
    d = d.withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 5 + F.when(F.col("id") % 100 == 0, 500).otherwise(0))
    b = learning.robust_least_squares(d, ["x", "z"], "y")
    assert abs(b["x"] - 3) < 0.01 and abs(b["z"] + 2) < 0.01 and abs(b["1"] - 5) < 0.1
    assert learning.forward_selection(d.where("id % 100 <> 0"), ["x", "z"], "y") == ["x", "z"]
    q = d.where("id = 1")
    got = learning.local_linear(q.withColumnRenamed("id", "q"), d.where("id % 100 <> 0 and z = 1").withColumnRenamed("id", "p"), "q", "p", "x", "y").first()
    assert abs(got["y"] - 6) < 0.5


def test_logs_are_read(spark, tmp_path):
    (tmp_path / "a.log").write_text("2016-01-02 10:00:00 0 0 510.5 600 20 21\nbroken line\n2016-01-02 10:00:06 0 0 511 601 20 21\n")
    assert [r["irr1"] for r in logs.logger(spark, str(tmp_path / "a.log")).orderBy("ts").collect()] == [510.5, 511.0]
    narrow = [str(i) for i in range(1, 40)]
    wide = [str(i) for i in range(1, 112)]
    for i in (26, 52, 78, 104):
        wide[i - 1] = "4"
    (tmp_path / "p.txt").write_text("\t".join(narrow) + "\n" + "\t".join(wide) + "\nx\n\n")
    got = {r["all_running"]: r["p_total"] for r in logs.power(spark, str(tmp_path / "p.txt")).collect()}
    assert got == {False: 2.0 + 12 + 22 + 32, True: 4.0 + 30 + 56 + 82}
    (tmp_path / "w.csv").write_text("2016,-999,3.5\n2017,4,-999\n")
    assert [tuple(r) for r in logs.weather(spark, str(tmp_path / "w.csv"), ["t", "a", "b"]).orderBy("t").collect()] == [("2016", None, "3.5"), ("2017", "4", None)]
    (tmp_path / "n.csv").write_text('1,"a,b";3\nx\n')
    assert [(r["c1"], r["t2"], r["c3"]) for r in logs.numbers(spark, str(tmp_path / "n.csv"), 3).collect()] == [(1.0, "a,b", 3.0), (None, None, None)]
    (tmp_path / "c.csv").write_text("# head\n2016-01-02T10:00:00.0/2016-01-02T10:01:00.0;a;b;c;0;10;6;4;1\n")
    assert logs.clear_sky(spark, str(tmp_path / "c.csv")).first()["ghi"] == 600.0
    (tmp_path / "f.txt").write_text("head\n  12 345\n")
    assert logs.fixed_width(spark, str(tmp_path / "f.txt"), {"a": (1, 4), "b": (5, 4)}, "^head").first().asDict() == {"a": 12.0, "b": 345.0}
    (tmp_path / "2016_05_06_09_50_00.jpeg").write_bytes(b"x")
    (tmp_path / "2016_05_06_08_50_00.jpeg").write_bytes(b"x")
    assert logs.image_files(spark, str(tmp_path), 10, 12, lead=15).count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.5, "a"), (2, float("nan"), None)], "i long, x double, s string")
    logs.write_tsv(d.coalesce(1), str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1\t2.5000\ta", "2\t\t"]
    logs.write_tsv(d.coalesce(1), str(tmp_path / "z"), nan_as_zero=True)
    assert "2\t0.0000\t" in [r["value"] for r in spark.read.text(str(tmp_path / "z")).collect()]
    logs.write_libsvm(d, str(tmp_path / "s"), "i", ["x"])
    assert spark.read.text(str(tmp_path / "s")).count() == 2
    logs.write_batches(spark.range(10), str(tmp_path / "b"), 3)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10
    got = logs.restamped(spark.createDataFrame([("2016-01-02T10:00:00/2016-01-02T10:01:00",)], "p string"), "p").first()
    assert got["p_start"] == "02-01-2016 10:00:00"
    assert logs.sql(spark, "SELECT :a AS a", a="x' OR '1").first()["a"] == "x' OR '1"


def test_assignment_equals_brute_force(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    rows = [(f, a, b, float(rng.integers(0, 40))) for f in range(12) for a in range(f % 5 + 1) for b in range(f % 4 + 1) if rng.random() < 0.8] + [(3, 0, 0, None)]
    got = relations.assigned(spark.createDataFrame(rows, "f long, a long, b long, c double"), "f", "a", "b", "c", alone=12.0).collect()
    for f in range(12):
        cost = {(a, b): c for g, a, b, c in rows if g == f and c is not None}
        left, right = {a for a, _ in cost}, {b for _, b in cost}
        total = lambda pairs: sum(cost[p] for p in pairs) + 12.0 * (len(left) + len(right) - 2 * len(pairs))
        mine = [(r["a"], r["b"]) for r in got if r["f"] == f]
        assert len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine)
        slots = [*right, *[None] * len(left)]
        best = min(total([p for p in zip(sorted(left), o) if p in cost]) for o in set(permutations(slots, len(left))) if all(b is None or (a, b) in cost for a, b in zip(sorted(left), o))) if left else 0
        assert total(mine) == pytest.approx(best)


def test_smoothing_goes_on_across_ranges_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, None if rng.random() < 0.1 else float(rng.normal())) for k in (1, 2, None) for t in range(400)]
    got = {(r["k"], r["t"]): r["v"] for r in series.ewma(spark.createDataFrame([r for r in rows if r[0]], "k long, t long, x double"), ["k"], ["t"], "x", 0.2, 5.0).collect()}
    for k in (1, 2):
        v = 5.0
        for _, t, x in (r for r in rows if r[0] == k):
            v = v if x is None else 0.8 * v + 0.2 * x
            assert got[(k, t)] == pytest.approx(v)


@pytest.mark.parametrize("share", [1e-6, 0.3, 0.9, 1.0])
def test_smoothing_over_many_blocks_and_buckets(spark, share):
    rng = np.random.default_rng(8)
    rows = [(k, int(t), float("nan") if t % 13 == 5 else None if t % 7 == 3 or t < 2 else float(rng.normal() * 10.0 ** int(rng.integers(-9, 9)))) for k in ("a", None) for t in range(1500)]
    rows += [("void", t, None) for t in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(3)
    got = {(r["k"], r["t"]): r["v"] for r in series.ewma(df, ["k"], ["t"], "x", share, 5.0, bucket=100).collect()}
    assert len(got) == len(rows)
    for k in ("a", None, "void"):
        v, size = 5.0, 5.0
        for _, t, x in (r for r in rows if r[0] == k):
            if x is not None and x == x:
                v, size = (1 - share) * v + share * x, (1 - share) * size + share * abs(x)
            assert abs(got[(k, t)] - v) <= 1e-11 * size


def test_neighbours_equal_brute_force_in_blocks(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(np.append(rng.exponential(5, 300), [50.0] * 20), rng.normal(size=320)))]
    d = spark.createDataFrame([*pts, (999, None, 1.0)], "i long, x double, y double")
    for p in (1.0, 2.0):
        got = relations.nearest_neighbours(d.where("i % 10 = 0"), d.withColumnRenamed("i", "j"), "i", "j", ["x", "y"], 4, p=p, per_block=20, own=False).collect()
        for i, x, y in pts[::10]:
            want = sorted((round(((abs(x - u) ** p + abs(y - v) ** p) ** (1 / p)), 9), j) for j, u, v in pts if j != i)[:4]
            assert [(round(r["distance"], 9), r["j"]) for r in sorted((r for r in got if r["i"] == i), key=lambda r: r["rank"])] == want


def test_grid_search_equals_fits_of_each_fold(spark):
    import zlib

    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(200, 2)), np.arange(200)
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=200)
    d = spark.createDataFrame([(int(i), *map(float, a), float(b)) for i, a, b in zip(ids, x, y)], "id long, a double, b double, y double")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    for c, e in learning.grid_search(d, ["a", "b"], "y", "id", [0.0, 50.0, 1000.0]):
        error, z = 0.0, np.column_stack([x, np.ones(200)])
        for f in range(5):
            t = z[fold != f]
            w = np.linalg.solve(t.T @ t + np.diag([c, c, 0.0]), t.T @ y[fold != f])
            error += ((z[fold == f] @ w - y[fold == f]) ** 2).sum()
        assert e == pytest.approx(np.sqrt(error / 200))


def test_areas_by_corners_and_small_ones_go(spark):
    px = [(1, x, y) for x, y in [(0, 0), (1, 1), (2, 0), (5, 5), (5, 6), (9, 9)]] + [(2, 0, 0)]
    got = {(r["frame"], r["component"]["x"], r["component"]["y"]): r["n"] for r in fields.areas(fields.components(spark.createDataFrame(px, "frame long, x long, y long"), "frame"), "frame").collect()}
    assert got == {(1, 0, 0): 3, (1, 5, 5): 2, (1, 9, 9): 1, (2, 0, 0): 1}
    assert fields.components(spark.createDataFrame([], "frame long, x long, y long"), "frame").count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT id % 2 AS k, timestamp_seconds(1700000000 + id * 20) AS ts, cast(id AS double) AS u, cast(3 * id AS double) AS z FROM range(60)").write.parquet(str(src))
    s = lambda: spark.readStream.schema("k long, ts timestamp, u double, z double").parquet(str(src))

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(stateful.minute_stream(s(), ["k"], "ts", "u"), "minutes", "complete").agg(F.sum("n")).first()[0] == 60
    assert run(stateful.kalman_stream(s(), "k", "ts", "u", "z"), "kalman", "append").count() == 60
    got = run(stateful.expert_stream(s().withColumn("w", F.col("u") * 3), "k", ["u", "w"], "z", rate=1e-4), "experts", "update").collect()
    assert sorted(r["n"] for r in got) == [30, 30] and all(abs(sum(r["weights"]) - 1) < 1e-9 and r["weights"][1] > 0.5 for r in got)
    p = s().select("k", "ts", F.col("u").alias("predicted"))
    t = s().select("k", "ts", F.col("u").alias("actual"))
    assert run(stateful.delayed_scores(p, t, ["k"], "40 SECONDS"), "scored", "append").count() == 58


def test_windows_and_sums_over_cut_series_equal_the_whole(spark):
    rows = [(k, None if i == 7 else (i * 37) % 101 if k else i % 3, i, float((i * i) % 17)) for k in (0, 1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t long, i long, v double")
    columns = lambda w: {"p": F.lag("v", 3).over(w), "n": F.lead("v", 2).over(w), "m": F.sum("v").over(w.rowsBetween(-3, 2))}
    got = series.windowed(df, ["k"], ["t", "i"], 3, 2, columns, size=5, bucket=10)
    want = df.select("*", *[c.alias(n) for n, c in columns(W.partitionBy("k").orderBy("t", "i")).items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = series.running(df, ["k"], ["t", "i"], F.col("v"), "s", bucket=10)
    want = df.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy("t", "i").rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = series.beside(df, ["k"], ["t", "i"], "v", bucket=10)
    w = W.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("_p", F.lag("v").over(w)).withColumn("_n", F.lead("v").over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert series.windowed(df.limit(0), ["k"], ["t", "i"], 3, 2, columns).count() == 0
    with pytest.raises(ValueError):
        series.windowed(df, ["k"], ["t"], 9, 0, columns, size=5)


def test_kalman_starts_anew_with_every_series_and_null(spark):
    rows = [(k, t, float(t % 5 + 1), None if t % 3 else 2.0 * t) for k in (None, 1, 2) for t in range(9)]
    df = spark.createDataFrame(rows, "k long, t long, u double, z double")
    got = series.kalman(df, ["k"], "t", "u", "z", p0=(1.0, 1e-6)).collect()
    by = {k: [round(r.y, 9) for r in sorted(got, key=lambda r: r.t) if r.k == k] for k in (None, 1, 2)}
    assert by[None] == by[1] == by[2] and len(by[1]) == 9


def test_changed_rows_by_key_and_null_key(spark):
    s = "k long, v string"
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, "d")], s), spark.createDataFrame([(2, "B"), (None, "N"), (9, "z")], s)
    got = logs.changed(old, new, ["k"], spark.createDataFrame([(4,), (9,)], "k long"))
    assert {(r.k, r.v) for r in got.collect()} == {(1, "a"), (2, "B"), (None, "N")}


def test_pixels_of_images_and_other_files(spark, tmp_path):
    import struct
    import zlib

    def png(rows, kind):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        width = len(rows[0]) // (3 if kind == 2 else 1)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[1, 2, 3, 200, 201, 202], [7, 8, 9, 255, 0, 128]], 2))
    (tmp_path / "g.png").write_bytes(png([[5, 250]], 0))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    got = {(r.origin[-5:], r.x, r.y): (r.red, r.green, r.blue) for r in logs.pixels(spark, str(tmp_path)).collect()}
    assert got == {("a.png", 0, 0): (1, 2, 3), ("a.png", 1, 0): (200, 201, 202), ("a.png", 0, 1): (7, 8, 9), ("a.png", 1, 1): (255, 0, 128), ("g.png", 0, 0): (5, 5, 5), ("g.png", 1, 0): (250, 250, 250)}


def test_signed_distance_of_one_sided_and_odd_frames(spark):
    rows = [("one", 0, 0, True), ("one", 5, 1, True), ("two", 3, 3, True), ("two", 6, 7, False), ("two", 3, 4, None)]
    got = fields.signed_distance(spark.createDataFrame(rows, "frame string, x long, y long, m boolean"), "frame", F.col("m"))
    assert {(r.frame, r.x): r.distance for r in got.where("frame = 'one' or y <> 4").collect()} == {("one", 0): None, ("one", 5): None, ("two", 3): 1.0, ("two", 6): -5.0}


def test_hinges_units_and_hyperplane_find_what_made_the_data(spark):
    rows = [(float(i % 40), float(i % 7), 3.0 + 2 * max(0, i % 40 - 20) - (i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    hinges, _, f = learning.hinge_regression(df, ["a", "b"], "y", knots=39, units=5)
    assert len(hinges) == 5 and df.agg(F.max(F.abs(f - F.col("y")))).first()[0] < 1.5
    _, g = learning.radial_network(df.select(F.col("a") / 40, F.col("b") / 7, "y").toDF("a", "b", "y"), ["a", "b"], "y", [[i / 4, j / 2] for i in range(5) for j in range(3)], 0.4)
    assert df.select((F.col("a") / 40).alias("a"), (F.col("b") / 7).alias("b"), "y").agg(F.sqrt(F.avg((g - F.col("y")) ** 2))).first()[0] < 2.5
    b, w = learning.linear_classifier(df.withColumn("s", (F.col("a") > 19.5).cast("int")), ["a", "b"], "s")
    assert df.where(((w["a"] * F.col("a") + w["b"] * F.col("b") + b) > 0) == (F.col("a") > 19.5)).count() > 570


def test_least_cost_equals_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        c, alone = rng.integers(0, 20, (n, m)).astype(float), 6.0
        full = np.block([[c, np.where(np.eye(n) > 0, alone, 1e9)], [np.where(np.eye(m) > 0, alone, 1e9), np.zeros((m, n))]])
        best = min(sum(full[i, p] for i, p in enumerate(q)) for q in permutations(range(n + m)))
        i, j = relations.least_cost(c, alone)
        assert c[i, j].sum() + alone * (n + m - 2 * len(i)) == best


def test_streams_of_tracks_and_forgetting_experts(spark, tmp_path):
    from datetime import datetime, timedelta

    def run(transform, rows, schema, name):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/in")
        s = transform(spark.readStream.schema(schema).parquet(f"{path}/in"))
        s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{path}/out").collect()

    at = lambda i: datetime(2020, 1, 1) + timedelta(seconds=i)
    moving = [(1, at(i), 3.0 * i, 0.0) for i in range(30) if i != 12] + [(1, at(i), 90.0 - 3 * i, 40.0) for i in range(30)] + [(1, at(5), 500.0, 500.0), (1, at(40), None, None)]
    for order in (2, 3):
        got = run(lambda s, o=order: stateful.track_stream(s, "k", "ts", "x", "y", order=o), moving, "k long, ts timestamp, x double, y double", f"tracks{order}")
        assert len(got) == 60 and len({r.track for r in got}) == 3
        assert all(len({r.track for r in got if r.y == v}) == 1 for v in (0.0, 40.0, 500.0))
    rows = [(1, at(i), 10.0 + i % 3, None if i % 5 == 0 else 10.5 + i % 3, 30.0, 10.0 + i % 3) for i in range(25)] + [(1, at(30), None, None, None, 1.0), (1, at(31), 5.0, 9.0, 40.0, None)]
    got = sorted(run(lambda s: stateful.forgetting_stream(s, "k", "ts", ["a", "b", "c"], "y", share=0.5), rows, "k long, ts timestamp, a double, b double, c double, y double", "experts"), key=lambda r: r.ts)
    s = np.zeros(3)
    for r, row in zip(got, sorted(rows, key=lambda r: r[1]), strict=True):
        f, ok = np.array([np.nan if v is None else v for v in row[2:5]]), [v is not None for v in row[2:5]]
        if not any(ok):
            assert r.predicted is None
            continue
        over = s[ok] - min(s[ok])
        q = np.quantile(over, 0.5, method="hazen")
        w = np.exp(-over / q) if q > 0 else (over == 0) * 1.0
        assert math.isclose(r.predicted, (w * f[ok]).sum() / w.sum())
        if row[5] is not None:
            e = np.abs(f - row[5])
            s = 0.95 * s + 0.05 * np.where(ok, e, np.nanmean(e))


def test_dirint_of_lone_rows_and_rows_of_no_class(spark):
    s = spark.createDataFrame([(1, 0, 500.0, 40.0, 150, "kept"), (2, 0, 500.0, 40.0, 150, None), (2, 1, 900.0, 30.0, 150, None), (3, 0, None, 40.0, 150, None)], "k long, t long, ghi double, z double, doy int, dni string")
    c = spark.createDataFrame([(k, z, d, 5, 0.5 if d == 7 else 0.25) for k in range(1, 7) for z in range(1, 7) for d in range(1, 8)], "kt int, z int, change int, water int, coefficient double")
    got = series.dirint(s, ["k"], ["t"], "ghi", "z", "doy", c)
    disc = {(r.k, r.t): r.v for r in s.select("k", "t", S.disc_dni(F.col("ghi"), F.col("z"), F.col("doy")).alias("v")).collect()}
    have = {(r.k, r.t): r.dni for r in got.collect()}
    assert have[1, 0] == pytest.approx(0.5 * disc[1, 0]) and have[2, 1] == pytest.approx(0.25 * disc[2, 1]) and have[2, 0] == pytest.approx(0.25 * disc[2, 0])
    assert not have[3, 0] and len(have) == 4
    assert [r.t_1 for r in series.lagged(s, ["k"], ["t"], ["t"], [1]).orderBy("k", "t").collect()] == [None, None, 0, None]


def test_bounded_least_squares_is_where_no_step_inside_the_bounds_helps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.5] + 4 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b), 1.0 + i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, w double")
    got = learning.bounded_least_squares(df, ["a", "b", "c"], "y", {"b": 0.0}, {"1": 3.0}, weight=F.col("w"))
    w, full = np.array([1.0 + i % 3 for i in range(200)]), np.column_stack([np.ones(200), x])
    slope = full.T @ (w * (full @ [got[k] for k in ("1", "a", "b", "c")] - y))
    assert got["b"] == 0 and got["1"] == 3 and slope[2] > 0 and slope[0] < 0 and abs(slope[1]) < 1e-5 and abs(slope[3]) < 1e-5
    free = learning.bounded_least_squares(df, ["a", "b", "c"], "y", {}, {})
    assert all(v == pytest.approx(learning.least_squares(df, ["a", "b", "c"], "y", interactions=False)[k], abs=1e-6) for k, v in free.items())
    assert set(learning.bounded_least_squares(df.limit(0), ["a"], "y", {"a": 1.0}, {}).values()) == {0.0, 1.0}


def test_file_list_is_kept_and_trees_predict_rows_without_target(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("cam_2015_08_01_09_30_00.jpeg", "cam_2015_08_01_23_30_00.jpeg", "other.jpeg"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert logs.listed(spark, f"{tmp_path}/in", f"{tmp_path}/kept", 6, 20).count() == 1
    (tmp_path / "in" / "cam_2015_08_01_09_30_08.jpeg").write_bytes(b"x")
    assert logs.listed(spark, f"{tmp_path}/in", f"{tmp_path}/kept", 6, 20).count() == 1
    df = spark.createDataFrame([(float(i), None if i == 50 else float(i > 30)) for i in range(100)] + [(None, 1.0)], "a double, y double")
    got = {r.a: r.prediction for r in learning.tree_ensemble(df, ["a"], "y", trees=5).collect()}
    assert len(got) == 100 and got[5.0] < 0.2 and got[50.0] > 0.8


def test_precise_sun_position_of_the_published_example(spark):
    from heliograph.functions import solar

    d = spark.sql("SELECT datediff(DATE '2003-10-17', DATE '2000-01-01') - 0.5D + (19 + 30 / 60D + 30 / 3600D) / 24 AS d UNION ALL SELECT NULL")
    got = solar.with_precise_sun_position(d, F.col("d"), 39.742476, -105.1786, 1830.14, 82000.0, 11.0, 67.0).orderBy(F.col("d").desc()).collect()
    assert abs(got[0]["azimuth"] - 194.34024) < 0.003 and abs(90 - got[0]["apparent_elevation"] - 50.11162) < 0.003
    assert got[1]["azimuth"] is None and got[1]["elevation"] is None


def test_precise_sun_position_takes_fuller_tables(spark):
    from heliograph.functions import solar

    d = spark.range(200).select((F.col("id") * 37.123).alias("d"))
    plain = lambda **k: [(r["azimuth"], r["elevation"]) for r in solar.with_precise_sun_position(d, F.col("d"), 43.5, 11.4, **k).orderBy("d").collect()]
    zeros = {k: [[*rows, (0.0, 1.0, 2.0)] for rows in v] for k, v in solar.EARTH.items()}
    assert plain(earth=zeros) == plain()
    moved = {**solar.EARTH, "longitude": [[*solar.EARTH["longitude"][0], (1e6, 0.0, 0.0)], *solar.EARTH["longitude"][1:]]}
    assert max(abs(a[1] - b[1]) for a, b in zip(plain(earth=moved), plain(), strict=True)) > 0.1


def test_assignment_of_many_frames_equals_all_permutations(spark):
    import itertools
    import random

    from heliograph.operators import relations

    rng, rows = random.Random(3), []
    for f in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        rows += [(f, a, b, rng.random() * 10) for a in range(n) for b in range(m) if rng.random() < 0.8]
    rows += [(0, None, 1, 0.0), (1, 1, None, 0.0), (2, 1, 1, None), (3, 0, 0, 9.0), (3, 0, 0, 0.5)]
    got = relations.assigned(spark.createDataFrame(rows, "f long, a long, b long, c double"), "f", "a", "b", "c", alone=4.0).collect()
    for f in range(60):
        cost = {}
        for g, a, b, c in rows:
            if g == f and None not in (a, b, c):
                cost[a, b] = min(c, cost.get((a, b), 99))
        left, right = sorted({a for a, _ in cost}), sorted({b for _, b in cost})
        picked = [(r["a"], r["b"]) for r in got if r["f"] == f]
        assert len({a for a, _ in picked}) == len({b for _, b in picked}) == len(picked)
        total = lambda p, cost=cost, k=len(left) + len(right): sum(cost.get(x, 1e9) for x in p) + 4.0 * (k - 2 * len(p))
        best = min((total(list(zip(x, y, strict=True))) for k in range(min(len(left), len(right)) + 1) for x in itertools.combinations(left, k) for y in itertools.permutations(right, k)), default=0)
        assert abs(total(picked) - best) < 1e-9


def test_threshold_separation_counts_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(f, x, y, rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 9])) for f in range(3) for x in range(7) for y in range(5)]
    got = fields.threshold_separation(spark.createDataFrame(rows, "f long, x int, y int, v int"), "f", F.col("v"), 6, 2.3, 1, 3).collect()
    want = {}
    for f in range(3):
        px = [(x, y, v) for g, x, y, v in rows if g == f and v and v <= 6]
        for x, y, v in px:
            for k in range(1, 7):
                want.setdefault((f, x // 3, y // 3, k), [0, 0.0])[0] += v == k
                for u, w, o in px:
                    if 0 < (x - u) ** 2 + (y - w) ** 2 <= 2.3**2 and (v < k - 1 and k + 1 < o or o < k - 1 and k + 1 < v):
                        want[f, x // 3, y // 3, k][1] += 0.5
    assert {(r["f"], r["tile_x"], r["tile_y"], r["level"]): [r["n"], r["separated"]] for r in got} == want
    assert any(w[1] for w in want.values())
    assert fields.threshold_separation(spark.createDataFrame([], "f long, x int, y int, v int"), "f", F.col("v"), 6, 2.3, 1, 3).count() == 0


# ---- fields much larger than the tables they are made from ------------------------------------------

QUERIES_OF_PIXELS = {"i5_shift": "SortMergeJoin [frame", "i15_polar": "SortMergeJoin [frame", "w5_median_filter": "MapInArrow", "i6_motion": "MapInArrow", "i6_fine_motion": "MapInArrow", "i12_sun_spots": "SortMergeJoin [frame"}


@pytest.mark.parametrize("name", QUERIES_OF_PIXELS)
def test_pixels_are_not_broadcast(spark, name):
    """Pixels are exploded from a small table, so Spark takes them for few."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert QUERIES_OF_PIXELS[name] in plan
    assert not re.search(r"Broadcast\w*Join \[[^\]]*\b(x|_k)#", plan)


def _uneven(seed, frames=7):
    """Fields with gaps, nulls, places that occur twice, negative places, and a null frame."""
    rng = np.random.default_rng(seed)
    rows = [(f"f{f}", x - 3, y - 2, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for f in range(frames) for x in range(6 + f) for y in range(9 - f) for _ in range(1 + (rng.random() < 0.05)) if rng.random() < 0.85]
    return [*rows, (None, 0, 0, 1.0), ("far", 5_000_000, -9, 2.0)]


def test_median_filter_of_uneven_fields(spark):
    rows = _uneven(1)
    want = {}
    for f, x, y, _ in rows:
        near = [v for g, a, b, v in rows if g == f and abs(a - x) <= 2 and abs(b - y) <= 2 and v is not None]
        if f is not None:
            want[f, x, y] = float(np.median(near)) if near else None
    got = fields.median_filter(spark.createDataFrame(rows, "frame string, x long, y long, value double"), "frame", 2).collect()
    assert len(got) == len(want) and {tuple(r)[:3]: r["value"] for r in got} == want


@pytest.mark.parametrize("rows_a_block", [100_000, 20])
def test_best_motion_of_uneven_fields(spark, monkeypatch, rows_a_block):
    """Ties, gaps and places that occur twice, frames in one block or several."""
    monkeypatch.setattr(fields.in_frames, "__defaults__", (rows_a_block,))
    before, after = _uneven(2), [(f, x + 1, y - 1, v) for f, x, y, v in _uneven(3)]
    errors = {}
    for f, x, y, v in before:
        for g, a, b, w in after:
            if f == g and f is not None and abs(a - x) <= 2 and abs(b - y) <= 2:
                errors.setdefault((f, a - x, b - y), []).extend([(w - v) ** 2] if None not in (v, w) else [])
    best = {}
    for (f, i, j), e in errors.items():
        best[f] = min(best.get(f, (2, 0, 0, 0)), (0, sum(e) / len(e), i, j) if e else (1, 0, i, j))
    kind = "frame string, x long, y long, value double"
    got = fields.best_motion(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), "frame", 2).collect()
    assert {r["frame"] for r in got} == set(best) and len(got) == len(best)
    for r in got:
        none, error, i, j = best[r["frame"]]
        assert (r["dx"], r["dy"]) == (i, j) and (r["error"] is None if none else abs(r["error"] - error) < 1e-9)


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
@pytest.mark.parametrize("own", [True, False])
def test_nearest_neighbours_of_uneven_points(spark, p, own):
    """Many equal points in one block that is parted, ties, nulls, NaN, ids that repeat; no pair of rows leaves a task but the
    nearest ones."""
    rng = np.random.default_rng(4)
    nan = float("nan")
    points = [(i % 500, float(rng.integers(0, 4)), float(rng.integers(0, 3))) for i in range(600)] + [(700, None, 1.0), (701, nan, 1.0), (702, 90.0, 0.0)]
    queries = [(i, float(rng.integers(0, 5)), float(rng.integers(0, 3))) for i in range(40)] + [(90, None, 0.0), (91, 95.0, nan)]
    got = relations.nearest_neighbours(spark.createDataFrame(queries, "q long, a double, b double"), spark.createDataFrame(points, "p int, a double, b double"), "q", "p", ["a", "b"], 7, p, per_block=20, own=own)
    assert "Join [_b" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")
    want = {}
    for q, a, b in queries[:40]:
        d = sorted(((abs(x - a) ** p + abs(y - b) ** p) ** (1 / p), i) for i, x, y in points if x is not None and x == x and (own or i != q))
        want |= {(q, k + 1): (i, pytest.approx(e)) for k, (e, i) in enumerate(d[:7])}
    rows = got.collect()
    assert len(rows) == len(want) and {(r["q"], r["rank"]): (r["p"], r["distance"]) for r in rows} == want


def test_classifier_counts_alike_rows_once(spark, monkeypatch):
    rows = [(i / 10, j / 10, int(i > j)) for i in range(10) for j in range(10) for _ in range(1 + i % 3)] + [(None, 0.1, 1), (0.1, 0.2, None)]
    seen = []
    monkeypatch.setattr(learning, "kept", lambda d, tag: seen.append(d) or d)
    b, w = learning.linear_classifier(spark.createDataFrame(rows, "v double, d double, y int"), ["v", "d"], "y")
    assert seen[0].count() == 100 and w["v"] > 0 > w["d"]
    right = [(w["v"] * v + w["d"] * d + b > 0) == y for v, d, y in rows if None not in (v, y)]
    assert np.mean(right) > 0.9


def test_tracks_make_no_data_frame_for_each_frame(monkeypatch):
    """A camera's frames are many and small: what pandas takes for one is more than its tracks do."""
    import pandas as pd

    class Detections:
        def __init__(self):
            self.schema = [type("F", (), {"name": n, "dataType": type("T", (), {"simpleString": lambda _: "double"})()}) for n in ("k", "ts", "x", "y")]
            self.select = self.groupBy = lambda *_: self
            self.applyInPandasWithState = lambda run, *_: run

    state = type("State", (), {"exists": False, "update": lambda self, v: None})()
    p = pd.DataFrame({"k": 1, "ts": [3, 1, 2, 1, 2, 4], "x": [2.0, 0.0, 1.0, 50.0, None, 300.0], "y": [0.0, 0.0, 0.0, 9.0, 1.0, None]})
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    got = pd.concat(stateful.track_stream(Detections(), "k", "ts", "x", "y")((1,), iter([p]), state))
    assert got[["ts", "x", "track"]].to_numpy().tolist() == [[1, 0, 0], [1, 50, 1], [2, 1, 0], [3, 2, 0]]
