"""Cloud masks: the small solvers by their optimality conditions, the steps by plain versions, masks by planted clouds."""

import numpy as np
import pytest

from heliograph.operators import fields, frames
from heliograph.plans import more as plans
from heliograph.sources import logs


def test_minima_meet_their_conditions():
    g = np.random.default_rng(4)
    for k in range(12):
        n = 6
        m = g.normal(size=(n, n))
        h, lin = 0.1 * m @ m.T, g.normal(size=n)
        a = np.concatenate([np.eye(n), -np.eye(n), g.normal(size=(5, n))])
        b = np.concatenate([np.full(2 * n, 2.0), np.full(5, 0.7)])
        terms = (g.integers(0, n, 20), np.full(20, 3.0), g.normal(size=20), g.normal(size=20))
        pairs = np.array([[i, 2.0, g.normal(), i + 1, 1.5, g.normal(), g.normal()] for i in range(n - 1)]) if k % 2 else ()
        x, lam, value = frames.barrier_minimum(h, lin, a, b, np.zeros(n), terms, pairs)
        grad, _ = frames._derivatives(x, h, lin, terms, np.asarray(pairs, float))
        assert (a @ x <= b + 1e-9).all() and (lam >= 0).all()
        assert np.abs(grad + a.T @ lam).max() < 1e-5 and (lam * (b - a @ x)).max() < 1e-6
        f = lambda y: frames._value(y, h, lin, terms, np.asarray(pairs, float))  # noqa: B023, E731
        e = 1e-5 * np.eye(n)
        assert np.allclose(grad, [(f(x + d) - f(x - d)) / 2e-5 for d in e], atol=1e-6)
        for _ in range(200):
            y = x + 1e-4 * g.normal(size=n)
            assert f(y) >= value - 1e-7 or (a @ y > b).any()


def test_curves_are_nowhere_negative_and_near():
    z = np.linspace(-1, 1, 40)
    c = np.linspace(-1.1, 1.1, 12)
    basis = np.concatenate([np.ones((40, 1)), np.tanh((z[:, None] - c) / 0.2)], axis=1)
    y = np.exp(-((z - 0.3) ** 2) / 0.1)
    w = frames.nonnegative_curve(basis, y, 1e-4)
    assert (basis @ w > -1e-9).all() and np.abs(basis @ w - y).max() < 0.2
    free = np.linalg.solve(basis.T @ basis + np.diag([1e-9] + [1e-4] * 12), basis.T @ y)
    assert ((basis @ w - y) ** 2).sum() >= ((basis @ free - y) ** 2).sum() - 1e-9


def test_otsu_minimum_between_two_peaks():
    x = np.arange(60)
    y = np.exp(-((x - 12) ** 2) / 30) + 0.6 * np.exp(-((x - 44) ** 2) / 30)
    assert 20 < frames.otsu_minimum(y) < 36
    assert frames.otsu_minimum(np.array([2.0, 1.0])) == 1 and frames.otsu_minimum(np.array([1.0])) == 0


def test_smooth_graph(spark):
    """Three nodes in a row: what pulls the outer ones apart meets a bound of the step between neighbours."""
    one = lambda *r: spark.createDataFrame([(g, *x) for g in (1, 2) for x in r], None)
    nodes = spark.createDataFrame([(g, i, -2.0, 2.0, None) for g in (1, 2) for i in (0, 1, 2)], "f long, node long, low double, high double, start double")
    terms = spark.createDataFrame([(1, 0, 1.0, 0.0, 1.0), (1, 2, 1.0, 0.0, -1.0)], "f long, node long, slope double, offset double, weight double")
    edges = spark.createDataFrame([(g, i, i + 1, 0.01, 0.5) for g in (1, 2) for i in (0, 1)], "f long, a long, b long, weight double, most double")
    pairs = spark.createDataFrame([], "f long, a long, slope_a double, offset_a double, b long, slope_b double, offset_b double, weight double")
    got = {(r["f"], r["node"]): r["value"] for r in frames.smooth_on_graph(nodes, terms, edges, pairs, "f", 1.0).collect()}
    assert got[1, 0] == pytest.approx(-0.5, abs=1e-4) and got[1, 1] == pytest.approx(0, abs=1e-4) and got[1, 2] == pytest.approx(0.5, abs=1e-4)
    assert len({round(got[2, i], 5) for i in range(3)}) == 1
    del one


S = frames.Segmentation(tile=8, reach=2, half_gap=1, step=0.2, resolution=0.4, pad=0.4, sun_radius=2, wide_sun_radius=4, clear_radius=2, outer_radius=10.0, glare=0.02)


def picture(frame, n=24):
    g = np.random.default_rng(frame)
    x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    cloud = (x - 6 - frame) ** 2 + (y - 14) ** 2 <= 36
    red = np.where(cloud, 170, 50) + g.integers(0, 12, (n, n))
    green = np.where(cloud, 175, 90) + g.integers(0, 12, (n, n))
    blue = np.where(cloud, 180, 200) + g.integers(0, 12, (n, n))
    return x, y, red, green, blue, cloud


def pixels(spark, frames_):
    rows = []
    for f in frames_:
        x, y, r, g, b, _ = picture(f)
        rows += [(f, *map(int, t)) for t in zip(x.ravel(), y.ravel(), r.ravel(), g.ravel(), b.ravel(), strict=True)]
    return spark.createDataFrame(rows, "frame long, x long, y long, red long, green long, blue long")


def suns(spark, frames_, flag=1):
    return spark.createDataFrame([(f, 20.0, 3.0, flag) for f in frames_], "frame long, sun_x double, sun_y double, flag int")


def plain_steps(frame, flag):
    """ratio and level of a picture, step by step."""
    x, y, r, g, b, _ = picture(frame)
    lr = lambda u, v: np.clip(np.log2(1e-8 + u / 255) - np.log2(1e-8 + v / 255), -6, 6)
    ratio, other = lr(r, b), lr(g, b)
    far = np.hypot(x - 20.0, y - 3.0)
    seen = far > (S.wide_sun_radius if flag == -9 else S.sun_radius)
    glare = seen & (g < np.minimum(r, b)) & ((ratio >= 0) | (other < 2 * ratio))
    order = sorted(zip(*np.nonzero(glare), strict=True), key=lambda p: (-round(ratio[p] - other[p], 9), p))
    for p in order[: round(seen.sum() * S.glare)]:
        seen[p] = False
    ratio = np.where(seen, ratio, np.nan)
    tiles = [ratio[i : i + 8, j : j + 8] for i in (0, 8, 16) for j in (0, 8, 16)]
    ends = [np.nanquantile(t, [S.quantile, 1 - S.quantile]) for t in tiles if np.isnan(t).mean() <= S.most_missing]
    low, high = min(e[0] for e in ends) - S.pad, max(e[1] for e in ends) + S.pad
    level = np.clip(np.round((ratio - low) / S.step + 1.5) + 1, 1, np.floor((high - low) / S.step + 3.5) + 1)
    around = np.full((28, 28), np.nan)
    around[2:-2, 2:-2] = level
    middle = np.array([[np.nanmedian(around[i : i + 5, j : j + 5]) for j in range(24)] for i in range(24)])
    return ratio, np.floor(middle + 0.5), low, high


@pytest.mark.parametrize("flag", [1, -9])
def test_levels_equal_the_plain_steps(spark, flag):
    d = frames.ratios(pixels(spark, [1, 2]), suns(spark, [1, 2], flag), "frame", S)
    levels, span = frames.tile_levels(d, "frame", S)
    ends = {r["frame"]: r for r in span.collect()}
    rows = levels.collect()
    for f in (1, 2):
        ratio, level, low, high = plain_steps(f, flag)
        assert ends[f]["low"] == pytest.approx(low) and ends[f]["high"] == pytest.approx(high)
        own = [r for r in rows if r["frame"] == f]
        assert len(own) == 576
        for r in own:
            want = ratio[r["x"], r["y"]]
            assert (r["ratio"] is None) == bool(np.isnan(want)) and (r["ratio"] is None or r["ratio"] == pytest.approx(want))
            assert (r["level"] is None and np.isnan(level[r["x"], r["y"]])) or r["level"] == level[r["x"], r["y"]]
            assert -1 <= r["prior"] <= 1


def test_masks_find_planted_clouds(spark):
    at = [1, 2, 5]
    out = frames.segment(pixels(spark, at), suns(spark, at), "frame", S, (24, 24)).collect()
    assert len(out) == 3 * 576
    for f in at:
        cloud = picture(f)[-1]
        own = [r for r in out if r["frame"] == f and r["cloud"] is not None]
        wrong = sum(r["cloud"] != bool(cloud[r["x"], r["y"]]) for r in own)
        assert len(own) > 540 and wrong <= 2
        v = np.full((24, 24), np.nan)
        for r in out:
            if r["frame"] == f:
                v[r["x"], r["y"]] = r["threshold"]
        assert np.abs(np.diff(v, axis=0)).max() <= S.most_step / S.tile + 1e-6


def test_a_clear_sun_is_clear_and_empty_frames_give_nothing(spark):
    out = frames.segment(pixels(spark, [1]), suns(spark, [1], 4), "frame", S, (24, 24)).collect()
    near = [r for r in out if np.hypot(r["x"] - 20, r["y"] - 3) <= S.clear_radius]
    assert near and not any(r["cloud"] for r in near)
    none = pixels(spark, [1]).limit(0)
    assert frames.segment(none, suns(spark, [1]), "frame", S, (24, 24)).collect() == []


def test_spread_is_bilinear_and_fills_tiles_without_a_value(spark):
    t = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 3.0), (1, 1, 1, 5.0)], "frame long, tile_x long, tile_y long, threshold double")
    p = spark.createDataFrame([(1, x, y) for x in range(8) for y in range(8)], "frame long, x long, y long")
    got = {(r["x"], r["y"]): r["threshold"] for r in frames.spread(t, p, "frame", 4, (8, 8)).collect()}
    v = np.array([[1.0, 3.0], [3.0, 5.0]])  # the missing one is the mean of the others
    for (x, y), g in got.items():
        u, w = min(max((x + 0.5) / 4 - 0.5, 0), 1), min(max((y + 0.5) / 4 - 0.5, 0), 1)
        assert g == pytest.approx((1 - u) * ((1 - w) * v[0, 0] + w * v[0, 1]) + u * ((1 - w) * v[1, 0] + w * v[1, 1]))


def test_pixmaps_round_trip(spark, tmp_path):
    d = pixels(spark, [3, 4]).withColumnRenamed("frame", "name")
    logs.write_pixmaps(d, "name", str(tmp_path / "img"))
    (tmp_path / "img" / "name=5").mkdir()
    (tmp_path / "img" / "name=5" / "x.txt").write_text("P3 # a comment\n2 1 255\n1 2 3 4 5")
    (tmp_path / "img" / "name=6").mkdir()
    (tmp_path / "img" / "name=6" / "x.txt").write_text("no image")
    got = logs.pixmaps(spark, str(tmp_path / "img")).collect()
    own = sorted((int(r["path"].split("name=")[1].split("/")[0]), r["x"], r["y"], r["red"], r["green"], r["blue"]) for r in got if "name=5" not in r["path"])
    assert own == sorted(tuple(r) for r in d.collect())
    assert sorted((r["x"], r["red"], r["blue"]) for r in got if "name=5" in r["path"]) == [(0, 1, 3), (1, 4, None)]


def test_components_of_many_frames(spark):
    g = np.random.default_rng(2)
    rows = [(f, int(x), int(y)) for f in range(30) for x, y in zip(*np.nonzero(g.random((15, 15)) < 0.45), strict=True)]
    rows += [(99, x, 0) for x in range(300)] + [(99, 5, 5), (99, 5, 5)]
    got = fields.components(spark.createDataFrame(rows, "f long, x long, y long"), "f").collect()
    assert len(got) == len(rows)
    pix = {}
    for f, x, y in rows:
        pix.setdefault(f, set()).add((x, y))
    want = {}
    for f, p in pix.items():
        left = set(p)
        while left:
            seed = min(left)
            todo, comp = [seed], set()
            while todo:
                q = todo.pop()
                if q in left:
                    left.discard(q)
                    comp.add(q)
                    todo += [(q[0] + i, q[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            want |= {(f, *q): seed for q in comp}
    assert all(want[r["f"], r["x"], r["y"]] == tuple(r["component"]) for r in got)


def test_registered():
    assert "i13_cloud_mask" in plans.QUERIES


def sun_picture(kind, n=61, at=(31, 29)):
    """A bright ground with nothing, a far spot, a dark disc or a dark star of six rays at a place."""
    x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    r, a = np.hypot(x - at[0], y - at[1]), np.arctan2(y - at[1], x - at[0])
    if kind == "none":
        dark = np.zeros((n, n), bool)
    elif kind == "far":
        dark = np.hypot(x - 31, y - 13) <= 5
    elif kind == "disc":
        dark = r <= 8
    else:
        dark = r <= 4 + 9 * np.maximum(0, np.cos(6 * a)) ** 3
    glow = 30 * np.cos(6 * a) * (r > 4) if kind == "star" else 0 * r
    return x, y, np.clip(np.where(dark, 10, 215 + glow), 0, 255).astype(int)


def test_flags_of_the_sun(spark):
    kinds = ["none", "far", "disc", "star", "outside"]
    rows = []
    for f, k in enumerate(kinds):
        x, y, v = sun_picture("star" if k == "outside" else k)
        rows += [(f, *map(int, t)) for t in zip(x.ravel(), y.ravel(), v.ravel(), v.ravel(), v.ravel(), strict=True)]
    p = spark.createDataFrame(rows, "frame long, x long, y long, red long, green long, blue long")
    places = spark.createDataFrame([(f, *((80.0, 30.0) if k == "outside" else (30.0, 30.0))) for f, k in enumerate(kinds)], "frame long, sun_x double, sun_y double")
    s = frames.SunSearch(reach=20, core=2, inner=14, outer=18, star_inner=14, star_least=20, star_outer=28, most_error=8.0, least_clear=(150.0, 0.6, 0.15, 0.0, 0.05))
    got = {r["frame"]: r for r in frames.detect_sun(p, places, "frame", s).collect()}
    assert [got[f]["flag"] for f in range(5)] == [1, -9, 2, 4, -1]
    assert abs(got[3]["sun_x"] - 31) <= 1 and abs(got[3]["sun_y"] - 29) <= 1 and got[3]["c3"] > got[2]["c3"] and got[3]["c5"] > got[2]["c5"]
    assert got[0]["sun_x"] is None and frames.detect_sun(p.limit(0), places, "frame", s).collect() == []


def test_star_of_six_points():
    _, _, v = sun_picture("star")
    s = frames.SunSearch(core=2, inner=14, outer=18, most_error=8.0)
    fill, free, _, middle = frames.star_shape(v.astype(float), (31, 29), (30.0, 30.0), s)
    _, _, w = sun_picture("disc")
    round_fill, round_free, _, _ = frames.star_shape(w.astype(float), (31, 29), (30.0, 30.0), s)
    assert free > 0.2 > round_free and round_fill > 0.85 and fill > 0.6 and middle == (31, 29)
    assert frames.star_shape(np.full((40, 40), 200.0), (20, 20), (20.0, 20.0), s) is None


def test_motion_below_a_pixel(spark):
    """Planted shifts, found to a twentieth of a pixel; a flat frame stays."""
    x, y = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    look = lambda u, v: 100 + 40 * np.sin((x - u) / 5) * np.cos((y - v) / 4) + 30 * np.cos((x - u) / 7 + (y - v) / 6)
    shifts = {1: (0.0, 0.0), 2: (0.35, -0.6), 3: (2.3, 1.7), 4: (-3.8, 0.45)}
    make = lambda s: [(f, int(i), int(j), float(w)) for f, (u, v) in s.items() for i, j, w in zip(x.ravel(), y.ravel(), look(u, v).ravel(), strict=True)]
    flat = [(9, i, j, 5.0) for i in range(8) for j in range(8)]
    before = spark.createDataFrame(make({f: (0.0, 0.0) for f in shifts}) + flat, "frame long, x long, y long, value double")
    after = spark.createDataFrame(make(shifts) + flat, "frame long, x long, y long, value double")
    got = {r["frame"]: (r["u"], r["v"]) for r in fields.fine_motion(before, after, "frame", rounds=3).collect()}
    assert got.pop(9) == (0.0, 0.0)
    assert all(abs(got[f][k] - shifts[f][k]) < 0.05 for f in shifts for k in (0, 1))
