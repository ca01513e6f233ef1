"""Image-like fields in long form: rows (frame, x, y, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def meet(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """left joined with right, both sorted. Pixels are often exploded from small tables or packed well in files, so Spark takes
    many of them for few and would broadcast them."""
    return left.join(right.hint("merge"), on, how)


def in_frames(d: DataFrame, frame: str, found: Callable, schema: str, rows: int = 100_000) -> DataFrame:
    """What found makes of Arrow tables that hold whole frames, as batches of frame and the columns of schema; a table has about
    so many rows, or one frame's. d is dealt by frame: a frame, an image, is one task's."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n = [*held, batch], n + batch.num_rows
            if n >= rows and held[0][frame][0] != batch[frame][-1]:  # up to the last frame, which may go on
                t = pa.Table.from_batches(held)
                codes = t[frame].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                cut = int(np.searchsorted(codes, codes[-1]))
                yield found(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                n -= cut
        if n:
            yield found(pa.Table.from_batches(held))

    d = d.repartition(frame).sortWithinPartitions(frame)
    return d.mapInArrow(run, f"`{frame}` {d.schema[frame].dataType.simpleString()}, {schema}")


def downscale(field: DataFrame, frame: str, k: int, value: str = "value", how=F.avg) -> DataFrame:
    """Boxes of k x k pixels as one, by mean (or how)."""
    cell = lambda c: F.floor(F.col(c) / k).cast("long").alias(c)
    return field.groupBy(frame, cell("x"), cell("y")).agg(how(value).alias(value))


def upscale(field: DataFrame, frame: str, k: int, value: str = "value") -> DataFrame:
    step = F.sequence(F.lit(0), F.lit(k - 1))
    d = field.select(frame, "x", "y", value, F.explode(step).alias("_i")).select("*", F.explode(step).alias("_j"))
    return d.select(frame, (F.col("x") * k + F.col("_i")).alias("x"), (F.col("y") * k + F.col("_j")).alias("y"), value)


def crop(field: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    return field.where(F.col("x").between(*x) & F.col("y").between(*y))


def shift(field: DataFrame, frame: str, dx: int, dy: int, value: str = "value") -> DataFrame:
    """The field moved by whole pixels; what comes from outside is null."""
    moved = field.select(frame, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), value)
    return meet(field.select(frame, "x", "y"), moved, [frame, "x", "y"], "left")


def box_filter(field: DataFrame, frame: str, n: int, value: str = "value", how=F.avg) -> DataFrame:
    """Separable filter over (2n + 1) x (2n + 1) pixels of a full grid, along x and then along y (mean, min or max)."""
    for line, along in (("y", "x"), ("x", "y")):
        field = field.withColumn(value, how(value).over(W.partitionBy(frame, line).orderBy(along).rowsBetween(-n, n)))
    return field


def median_filter(field: DataFrame, frame: str, n: int, value: str = "value") -> DataFrame:
    """Median over (2n + 1) x (2n + 1) pixels, nulls and missing ones left out: pixels look up those around them by position,
    many frames at once; a frame, an image, is one task's."""
    import numpy as np
    import pyarrow as pa

    d = field.select(frame, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("_v")).dropna(subset=[frame, "x", "y"])
    steps = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)]

    def found(t: pa.Table) -> pa.RecordBatch:
        key = t[frame].combine_chunks().dictionary_encode()
        g, x, y = key.indices.to_numpy().astype(np.int64), t["x"].to_numpy(), t["y"].to_numpy()
        wide, high = (int(c.max() - c.min()) + 2 * n + 1 for c in (x, y))
        at = (g * wide + x - x.min() + n) * high + y - y.min() + n  # without a step to another row or frame
        place, first = np.unique(at, return_index=True)
        known = t["_v"].is_valid().to_numpy()
        at, v = at[known], t["_v"].fill_null(0.0).to_numpy()[known]
        order = np.argsort(at, kind="stable")
        at, v = np.append(at[order], np.iinfo(np.int64).max), np.append(v[order], 0.0)
        most = int(np.bincount(np.searchsorted(place, at[:-1]), minlength=1).max())  # of one place's values
        out, count, block = np.full(len(place), np.nan), np.zeros(len(place), np.int64), max(1, 4_000_000 // len(steps))
        for k in range(0, len(place), block):
            p = place[k : k + block]
            near, has = np.full((len(steps) * most, len(p)), np.nan), count[k : k + block]  # NaN, the largest value, sorts last
            for m, (i, j) in enumerate(steps):
                to = p + i * high + j
                q = np.searchsorted(at, to)
                for c in range(most):
                    hit = np.flatnonzero(at[np.minimum(q + c, len(at) - 1)] == to)
                    near[m * most + c, hit] = v[q[hit] + c]
                    has[hit] += 1
            near.sort(axis=0)
            some = np.flatnonzero(has)
            out[k + some] = 0.5 * near[(has[some] - 1) // 2, some] + 0.5 * near[has[some] // 2, some]
        return pa.RecordBatch.from_arrays([key.dictionary.take(pa.array(g[first])), t["x"].combine_chunks().take(pa.array(first)), t["y"].combine_chunks().take(pa.array(first)), pa.array(out, mask=count == 0)], names=[frame, "x", "y", value])

    kinds = {c: field.schema[c].dataType for c in ("x", "y")}
    return in_frames(d, frame, found, f"x long, y long, `{value}` double").select(frame, *[F.col(c).cast(k).alias(c) for c, k in kinds.items()], value)


def best_motion(before: DataFrame, after: DataFrame, frame: str, reach: int, value: str = "value") -> DataFrame:
    """frame, dx, dy, error: the whole-pixel motion within reach of the least mean squared error; ties take the smallest.

    The candidates are a fixed list that the earlier field is moved by; pixels meet by position, those of many frames at
    once. Both fields are dealt by frame, a frame, an image, to one task.
    """
    import numpy as np
    import pyarrow as pa

    part = lambda f, side: f.where(F.col(frame).isNotNull()).select(frame, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("_v"), F.lit(side).alias("_after")).dropna(subset=["x", "y"])
    d = part(before, False).union(part(after, True))
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]

    def found(t: pa.Table) -> pa.RecordBatch:
        key = t[frame].combine_chunks().dictionary_encode()
        g, frames = key.indices.to_numpy(), len(key.dictionary)
        x, y, later = (t[c].to_numpy() for c in ("x", "y", "_after"))
        known, v = t["_v"].is_valid().to_numpy(), t["_v"].fill_null(0.0).to_numpy()
        wide, high = (int(c.max() - c.min()) + 2 * reach + 1 for c in (x, y))
        at = (g * wide + x - x.min() + reach) * high + y - y.min() + reach  # without a step to another row or frame
        order = np.argsort(at, kind="stable")
        b, a = order[~later[order]], order[later[order]]
        once = (np.diff(at[b]) > 0).all()
        error, any_pair = np.full((len(steps), frames), np.nan), np.zeros((len(steps), frames), bool)
        for k, (i, j) in enumerate(steps):
            to = at[a] - i * high - j
            p = np.searchsorted(at[b], to)
            if once:
                q = np.flatnonzero(at[b][np.minimum(p, len(b) - 1)] == to) if len(b) else np.zeros(0, int)
                p = p[q]
            else:  # rows of one place all meet
                n = np.searchsorted(at[b], to, "right") - p
                q = np.repeat(np.arange(len(a)), n)
                p = p[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            one, two = b[p], a[q]
            any_pair[k] = np.bincount(g[two], minlength=frames) > 0
            ok = known[one] & known[two]
            n = np.bincount(g[two], ok, frames)
            e = np.where(ok, v[two] - v[one], 0.0)
            error[k] = np.divide(np.bincount(g[two], e * e, frames), n, out=np.full(frames, np.nan), where=n > 0)
            any_pair[k] |= n > 0
        best = np.where(any_pair, np.where(np.isnan(error), np.finfo(float).max, error), np.inf).argmin(axis=0)  # the first of equal ones
        some = np.flatnonzero(any_pair.any(axis=0))
        move, least = np.array(steps, np.int64)[best[some]], error[best[some], some]
        return pa.RecordBatch.from_arrays([key.dictionary.take(pa.array(some)), pa.array(move[:, 0]), pa.array(move[:, 1]), pa.array(least, from_pandas=True)], names=[frame, "dx", "dy", "error"])

    return in_frames(d, frame, found, "dx long, dy long, error double")


def otsu(levels: DataFrame, frame: str, level: str, n: str) -> DataFrame:
    """frame, threshold: of a histogram (frame, level, n), the level that parts it with the most variance between."""
    w = W.partitionBy(frame)
    upto = w.orderBy(level).rowsBetween(W.unboundedPreceding, 0)
    lv, c = F.col(level).cast("double"), F.col(n).cast("double")
    d = levels.select(frame, lv.alias("l"), F.sum(c).over(upto).alias("n0"), F.sum(c * lv).over(upto).alias("s0"), F.sum(c).over(w).alias("nt"), F.sum(c * lv).over(w).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1
    d = d.where(n1 > 0).withColumn("between", F.round(F.col("n0") * n1 * gap * gap / (F.col("nt") * F.col("nt")), 9))
    return d.groupBy(frame).agg(F.min(F.struct(-F.col("between"), "l")).alias("m")).select(frame, F.col("m.l").alias("threshold"))


def enclosed(field: DataFrame, frame: str, contour: Column, inside: Column) -> DataFrame:
    """field with enclosed: pixels that meet inside and have a contour pixel on the four rays of their row and column, or
    of the rows and columns beside."""
    d = field.withColumn("_c", contour.cast("int"))
    row, col = W.partitionBy(frame, "y").orderBy("x"), W.partitionBy(frame, "x").orderBy("y")
    for name, w in (("_l", row.rowsBetween(W.unboundedPreceding, 0)), ("_r", row.rowsBetween(0, W.unboundedFollowing)), ("_u", col.rowsBetween(W.unboundedPreceding, 0)), ("_d", col.rowsBetween(0, W.unboundedFollowing))):
        d = d.withColumn(name, F.max("_c").over(w))
    for name, w in (("_l", col), ("_r", col), ("_u", row), ("_d", row)):
        d = d.withColumn(name, F.max(name).over(w.rowsBetween(-1, 1)))
    return d.withColumn("enclosed", inside & (F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") == 4)).drop("_c", "_l", "_r", "_u", "_d")


def components(pixels: DataFrame, frame: str) -> DataFrame:
    """pixels (frame, x, y, ...) of a mask with component: the smallest x, then y, of the pixels joined to it by touching
    sides or corners, as a struct. Many frames are labelled at once; a frame, an image, is one task's."""
    import numpy as np
    import pandas as pd

    def label(parts):
        for p in parts:
            n = np.array([len(v) for v in p["_x"]], np.int64)
            if not n.sum():
                continue
            f, x, y = np.repeat(np.arange(len(n)), n), np.concatenate(list(p["_x"])), np.concatenate(list(p["_y"]))
            high = int(y.max() - y.min()) + 3  # a column, and a pixel on either side that is none
            wide = int(x.max() - x.min()) + 3
            key, back = np.unique((f * wide + x - x.min()) * high + y - y.min(), return_inverse=True)
            a, b = [], []
            for step in (1, high - 1, high, high + 1):
                at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
                hit = np.flatnonzero(key[at] == key + step)
                a.append(hit)
                b.append(at[hit])
            a, b = np.concatenate(a), np.concatenate(b)
            up = np.arange(len(key))
            while True:
                low = up.copy()
                np.minimum.at(low, up[a], up[b])
                np.minimum.at(low, up[b], up[a])
                np.minimum.at(low, a, up[b])
                np.minimum.at(low, b, up[a])
                while (low[low] != low).any():
                    low = low[low]
                if (low == up).all():
                    break
                up = low
            root = key[up[back]]
            yield pd.DataFrame({frame: p[frame].repeat(n).to_numpy(), "x": x, "y": y, "cx": root // high % wide + x.min(), "cy": root % high + y.min()})

    place = F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))).alias("_p")
    whole = set(pixels.columns) == {frame, "x", "y"}
    d = (pixels if whole else pixels.select(frame, "x", "y").distinct()).groupBy(frame).agg(place).select(frame, F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    found = d.mapInPandas(label, f"`{frame}` {pixels.schema[frame].dataType.simpleString()}, x long, y long, cx long, cy long")
    return (found if whole else meet(pixels, found, [frame, "x", "y"])).withColumn("component", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))).drop("cx", "cy")


def areas(labelled: DataFrame, frame: str, least: int = 1, most: int | None = None) -> DataFrame:
    """frame, component, n, box (x0, x1, y0, y1) and centroid (cx, cy) of the components of least to most pixels."""
    a = labelled.groupBy(frame, "component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return a.where(F.col("n") >= least) if most is None else a.where(F.col("n").between(least, most))


def saturation_factor(field: DataFrame, frame: str, contour: Column, inside: Column, most: float = 0.6, least: int = 10, sun_flag: str | None = None) -> DataFrame:
    """frame, factor: the share of enclosed pixels, without areas of fewer than least, up to most; 0 where sun_flag is 4."""
    d = enclosed(field, frame, contour, inside)
    flag = F.max(F.col(sun_flag) == 4) if sun_flag else F.lit(False)
    total = d.groupBy(frame).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(flag, F.lit(False)).alias("_f"))
    kept = areas(components(d.where("enclosed").select(frame, "x", "y"), frame), frame, least).groupBy(frame).agg(F.sum("n").alias("_k"))
    return total.join(kept, frame, "left").select(frame, F.when(F.col("_f"), 0.0).otherwise(F.least(F.lit(most), F.coalesce("_k", F.lit(0)) / F.col("_n"))).alias("factor"))


def cloud_mask(red: Column, green: Column, blue: Column, near_sun: Column) -> Column:
    """Cloud pixels by the red-blue ratio and brightness; around the sun by the green-blue ratio."""
    return F.when(near_sun, F.try_divide(green, blue) > 0.96).otherwise((F.try_divide(red, blue) > 0.92) & (red + green + blue > 250))


def local_minimum(levels: DataFrame, frame: str, level: str, n: str, start: DataFrame) -> DataFrame:
    """frame, minimum: where a histogram (frame, level, n) of consecutive levels comes to rest, going down from start (frame,
    threshold): to the left if n falls there and does not to the right, else to the right if it falls there."""
    w = W.partitionBy(frame).orderBy("l")
    d = levels.select(frame, F.col(level).cast("double").alias("l"), F.col(n).cast("double").alias("c")).withColumn("p", F.lag("c").over(w)).withColumn("q", F.lead("c").over(w)).join(start, frame)
    left = F.coalesce(F.col("p") < F.col("c"), F.lit(False))  # a step to the left goes down
    right = F.coalesce(F.col("q") < F.col("c"), F.lit(False))
    own = F.col("l") == F.col("threshold")
    side = F.max(F.when(own & left & ~right, -1).when(own & right, 1).when(own, 0))
    rest_left = F.max(F.when((F.col("l") < F.col("threshold")) & ~left, F.col("l")))
    rest_right = F.min(F.when((F.col("l") > F.col("threshold")) & ~right, F.col("l")))
    return d.groupBy(frame).agg(F.when(side == -1, rest_left).when(side == 1, rest_right).otherwise(F.max("threshold")).alias("minimum"))


def polar(field: DataFrame, frame: str, centre: tuple[float, float], angles: list[float], radii: list[float], value: str = "value") -> DataFrame:
    """frame, a, r, value: the field around a centre (x, y) at indices of angles and radii, bilinear between pixels; null
    where one of the four is missing."""
    steps = lambda xs: F.posexplode(F.array(*[F.lit(float(x)) for x in xs]))
    at = field.select(frame).distinct().select(frame, steps(angles).alias("a", "_a")).select("*", steps(radii).alias("r", "_r"))
    at = at.withColumn("_x", centre[0] + F.cos("_a") * F.col("_r")).withColumn("_y", centre[1] + F.sin("_a") * F.col("_r")).withColumn("_i", F.floor("_x")).withColumn("_j", F.floor("_y"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = at.withColumn("_c", corner).withColumn("x", F.col("_i") + F.col("_c.i")).withColumn("y", F.col("_j") + F.col("_c.j"))
    share = lambda t, u, c: F.when(F.col(c) == 0, 1 - (F.col(t) - F.col(u))).otherwise(F.col(t) - F.col(u))
    at = at.withColumn("_w", share("_x", "_i", "_c.i") * share("_y", "_j", "_c.j")).where("_w > 0")
    got = meet(at, field.select(frame, "x", "y", F.col(value).alias("_v")), [frame, "x", "y"], "left")
    return got.groupBy(frame, F.col("a").cast("long").alias("a"), F.col("r").cast("long").alias("r")).agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_v") * F.col("_w"))).alias(value))


def rotation(pairs: DataFrame, a: list[str], b: list[str]) -> list[list[float]]:
    """The rotation R with b ~ R a in least squares (Kabsch): nine sums in Spark, their 3 x 3 SVD on the driver."""
    import numpy as np

    sums = pairs.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{i}{j}") for i, p in enumerate(b) for j, q in enumerate(a)]).first()
    u, _, v = np.linalg.svd(np.array([[sums[f"{i}{j}"] for j in range(3)] for i in range(3)], float))
    return (u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v).tolist()


def signed_distance(field: DataFrame, frame: str, inside: Column) -> DataFrame:
    """frame, x, y, distance: to the nearest pixel of the other side, positive inside; null in frames of one side only. A frame,
    an image, is one task: distances along columns first, then the least over each row."""
    import numpy as np
    import pandas as pd

    d = field.select(frame, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce(inside, F.lit(False)).alias("_in"))

    def squared(mask: np.ndarray) -> np.ndarray:
        """The squared distance of every pixel to the nearest one of the mask."""
        n, m = mask.shape
        along = np.abs(np.arange(m)[:, None] - np.arange(m)[None, :]).astype(float) ** 2
        column = np.stack([np.where(row, along, np.inf).min(axis=1) for row in mask])
        across = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]).astype(float) ** 2
        return np.stack([(column + a[:, None]).min(axis=0) for a in across])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, y = (p["x"] - p["x"].min()).to_numpy(), (p["y"] - p["y"].min()).to_numpy()
        side = np.zeros((x.max() + 1, y.max() + 1), np.int8)  # 0: no pixel here
        side[x, y] = np.where(p["_in"], 2, 1)
        to_out, to_in = np.sqrt(squared(side == 1)), np.sqrt(squared(side == 2))
        got = np.where(p["_in"], to_out[x, y], -to_in[x, y])
        return p[[frame, "x", "y"]].assign(distance=pd.Series(got, p.index).where(np.isfinite(got)))

    return d.groupBy(frame).applyInPandas(run, f"`{frame}` {d.schema[frame].dataType.simpleString()}, x long, y long, distance double")


def sun_decision(seen: Column, spot: Column, contrast: Column, criteria: list[Column], most_covered: list[float], least_clear: list[float], dark: float) -> Column:
    """The sun's flag in a frame: -1 outside the image; without a dark spot near its place 1 (covered), or -9 (unclear) if
    a contrast over dark is elsewhere; with one 2, 4 or 3 as all criteria stay low, all reach those of a clear sun, or neither."""
    every = lambda f, ends: F.expr("true") if not ends else sum((f(c, e).cast("int") for c, e in zip(criteria, ends, strict=True)), F.lit(0)) == len(ends)
    low, high = every(lambda c, e: c <= e, most_covered), every(lambda c, e: c >= e, least_clear)
    return F.when(~seen, -1).when(~spot, F.when(contrast > dark, -9).otherwise(1)).when(low, 2).when(high, 4).otherwise(3)


def template_match(field: DataFrame, frame: str, template: dict[tuple[int, int], float], value: str = "value") -> DataFrame:
    """frame, x, y, score: where the template, values at offsets (dx, dy), correlates most with the field; ties take the
    smallest x, then y. Places where it isn't wholly inside, or the field is flat below it, don't count."""
    n, s, ss = len(template), sum(template.values()), sum(w * w for w in template.values())
    part = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in template.items()]))
    v = F.col(value).cast("double")
    d = field.where(v.isNotNull()).select(frame, "x", "y", v.alias("_v"), part.alias("_t"))
    d = d.groupBy(frame, (F.col("x") - F.col("_t.dx")).alias("x"), (F.col("y") - F.col("_t.dy")).alias("y")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_ss"), F.sum(F.col("_v") * F.col("_t.w")).alias("_sw"))
    spread = (n * F.col("_ss") - F.col("_s") * F.col("_s")) * (n * ss - s * s)
    d = d.where((F.col("_n") == n) & (spread > 0)).withColumn("score", F.round((n * F.col("_sw") - s * F.col("_s")) / F.sqrt(spread), 9))
    best = d.groupBy(frame).agg(F.min(F.struct((-F.col("score")).alias("s"), "x", "y")).alias("m"))
    return best.select(frame, F.col("m.x").alias("x"), F.col("m.y").alias("y"), (-F.col("m.s")).alias("score"))


def threshold_separation(field: DataFrame, frame: str, level: Column, levels: int, radius: float, half_gap: int, tile: int) -> DataFrame:
    """frame, tile_x, tile_y, level, n, separated for every level 1..levels of every tile that has pixels.

    n: the tile's pixels of the level. separated: the pairs of pixels within radius of each other of which one is more than
    half_gap below the level and one more than half_gap above, as a good threshold between sky and cloud has many; a pair
    over two tiles counts half to each. Pixels with a null level or one outside 1..levels don't count. A frame, an image
    with x and y from 0, is one group; levels are counted by differences, not one by one for each pair.
    """
    import numpy as np
    import pandas as pd

    at = range(-int(radius), int(radius) + 1)
    offsets = [(i, j) for i in at for j in at if (i, j) > (0, 0) and i * i + j * j <= radius * radius]
    d = field.select(frame, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), level.cast("long").alias("_l")).where(F.col("_l").between(1, levels))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        seen = np.zeros((x.max() + 1, y.max() + 1), np.int64)  # 0: no pixel here
        seen[x, y] = p["_l"]
        wide, high = seen.shape
        down = high // tile + 1
        tiles = np.arange(wide)[:, None] // tile * down + np.arange(high)[None, :] // tile
        cells = (tiles.max() + 1) * (levels + 2)
        change = np.zeros(cells)
        for i, j in offsets:
            if i >= wide or abs(j) >= high:
                continue
            here = np.s_[: wide - i, max(0, -j) : high - max(0, j)]
            there = np.s_[i:, max(0, j) : high - max(0, -j)]
            low, top = np.minimum(seen[here], seen[there]), np.maximum(seen[here], seen[there])
            on = (low > 0) & (top - low >= 2 * half_gap + 2)
            for t in (tiles[here][on], tiles[there][on]):
                change += 0.5 * (np.bincount(t * (levels + 2) + low[on] + half_gap + 1, minlength=cells) - np.bincount(t * (levels + 2) + top[on] - half_gap, minlength=cells))
        own = np.bincount(tiles[x, y] * (levels + 2) + p["_l"].to_numpy(), minlength=cells).reshape(-1, levels + 2)
        some, k = np.flatnonzero(own.sum(axis=1)), np.arange(1, levels + 1)
        sums = change.reshape(-1, levels + 2).cumsum(axis=1)
        return pd.DataFrame({frame: p[frame].iat[0], "tile_x": np.repeat(some // down, levels), "tile_y": np.repeat(some % down, levels), "level": np.tile(k, len(some)), "n": own[some][:, k].ravel(), "separated": sums[some][:, k].ravel()})

    return d.groupBy(frame).applyInPandas(run, f"`{frame}` {d.schema[frame].dataType.simpleString()}, tile_x long, tile_y long, level long, n long, separated double")


def moved_by(field: DataFrame, motion: DataFrame, frame: str, scale: int = 1, value: str = "value") -> DataFrame:
    """The field moved by each frame's (u, v) / scale, bilinear between pixels; pixels that come from outside in part are left
    out. motion: (frame, u, v), a row a frame."""
    m = motion.select(frame, (F.col("u") / scale).alias("_u"), (F.col("v") / scale).alias("_v"))
    m = m.select(frame, F.floor("_u").alias("_i"), F.floor("_v").alias("_j"), (F.col("_u") - F.floor("_u")).alias("_fu"), (F.col("_v") - F.floor("_v")).alias("_fv"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    share = lambda f, k: F.when(F.col(k) == 1, F.col(f)).otherwise(1 - F.col(f))
    d = meet(field, m, frame).select(frame, "x", "y", F.col(value).alias("_value"), "_i", "_j", "_fu", "_fv", corner.alias("_c"))
    d = d.select(frame, (F.col("x") + F.col("_i") + F.col("_c.i")).alias("x"), (F.col("y") + F.col("_j") + F.col("_c.j")).alias("y"), "_value", (share("_fu", "_c.i") * share("_fv", "_c.j")).alias("_w"))
    d = d.groupBy(frame, "x", "y").agg(F.sum(F.col("_value") * F.col("_w")).alias(value), F.sum("_w").alias("_w"))
    return d.where(F.col("_w") > 1 - 1e-9).drop("_w")


def fine_motion(before: DataFrame, after: DataFrame, frame: str, scales: tuple[int, ...] = (4, 2, 1), rounds: int = 4, value: str = "value") -> DataFrame:
    """frame, u, v: the motion, to fractions of a pixel, that takes the earlier field nearest to the later one.

    From coarse to fine boxes, each round moves the earlier field by what is known, as moved_by does, and adds the
    Gauss-Newton step that five sums over a frame's pixels give: of its slopes' products, and of these with what is left. A
    motion so large that fields don't overlap at the coarsest scale isn't found; frames without slopes stay at 0. Fields are
    dealt once, and rounds run over many frames at a time; a frame, an image, is one task's.
    """
    import numpy as np
    import pyarrow as pa

    part = lambda f, side: f.select(frame, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias("_v"), F.lit(side).alias("_after"))

    def found(t: pa.Table) -> pa.RecordBatch:
        key = t[frame].combine_chunks().dictionary_encode(null_encoding="encode")
        g, n, later = key.indices.to_numpy(), len(key.dictionary), t["_after"].to_numpy()
        asked = np.flatnonzero(np.bincount(g, ~later, n) > 0)  # frames of the earlier field
        on = (t["x"].is_valid().to_numpy()) & (t["y"].is_valid().to_numpy()) & key.dictionary.is_valid().to_numpy(zero_copy_only=False)[g]
        g, later, known, v = g[on], later[on], t["_v"].is_valid().to_numpy()[on], t["_v"].fill_null(0.0).to_numpy()[on]
        place = [t[c].fill_null(0).to_numpy()[on] for c in ("x", "y")]
        u = np.zeros((2, n))
        for k in scales if len(g) else ():
            x, y = (c // k for c in place)
            x0, y0 = (np.full(n, np.iinfo(np.int64).max) for _ in range(2))
            np.minimum.at(x0, g, x)
            np.minimum.at(y0, g, y)
            x, y = x - x0[g] + 1, y - y0[g] + 1  # a pixel that is none on every side
            wide, high = int(x.max()) + 2, int(y.max()) + 2
            cell, size = (g * wide + x) * high + y, n * wide * high

            def grid(side):  # whether a pixel is there, is known, and its value
                there = np.bincount(cell[side], minlength=size)  # noqa: B023
                count = np.bincount(cell[side], known[side], size)  # noqa: B023
                mean = np.divide(np.bincount(cell[side], v[side], size), count, out=np.zeros(size), where=count > 0)  # noqa: B023
                return there.reshape(n, wide, high) > 0, count.reshape(n, wide, high) > 0, mean.reshape(n, wide, high)  # noqa: B023

            (b_there, b_known, b), (a_there, a_known, a) = grid(~later), grid(later)
            for _ in range(rounds):
                low = np.floor(u / k)
                part_of = u / k - low
                low = np.clip(low, -(2**40), 2**40).astype(np.int64)
                weight, seen, moved = np.zeros(b.shape), np.zeros(b.shape, bool), np.zeros(b.shape)
                for i in (0, 1):
                    for j in (0, 1):
                        xs, ys = np.arange(wide)[None, :] - low[0][:, None] - i, np.arange(high)[None, :] - low[1][:, None] - j
                        inside = ((xs >= 0) & (xs < wide))[:, :, None] & ((ys >= 0) & (ys < high))[:, None, :]
                        at = (np.arange(n)[:, None, None], np.clip(xs, 0, wide - 1)[:, :, None], np.clip(ys, 0, high - 1)[:, None, :])
                        w = ((part_of[0] if i else 1 - part_of[0]) * (part_of[1] if j else 1 - part_of[1]))[:, None, None]
                        weight += w * (inside & b_there[at])
                        ok = inside & b_known[at]
                        moved += np.where(ok, w * b[at], 0.0)
                        seen |= ok
                there = weight > 1 - 1e-9
                seen &= there
                gx, gy, slope = np.zeros(b.shape), np.zeros(b.shape), there & a_there
                gx[:, 1:-1] = (moved[:, 2:] - moved[:, :-2]) / 2
                gy[:, :, 1:-1] = (moved[:, :, 2:] - moved[:, :, :-2]) / 2
                slope[:, 1:-1] &= seen[:, 2:] & seen[:, :-2]
                slope[:, :, 1:-1] &= seen[:, :, 2:] & seen[:, :, :-2]
                slope[:, [0, -1]], slope[:, :, [0, -1]] = False, False
                gx, gy, rest = np.where(slope, gx, 0.0), np.where(slope, gy, 0.0), np.where(slope & seen & a_known, a - moved, 0.0)
                xx, xy, yy, xr, yr = (np.einsum("gij,gij->g", p, q) for p, q in ((gx, gx), (gx, gy), (gy, gy), (gx, rest), (gy, rest)))
                det = xx * yy - xy * xy
                ok = det > 1e-9 * xx * yy
                u = u - k * np.divide([yy * xr - xy * yr, xx * yr - xy * xr], det, out=np.zeros((2, n)), where=ok)
        return pa.RecordBatch.from_arrays([key.dictionary.take(pa.array(asked)), pa.array(u[0][asked]), pa.array(u[1][asked])], names=[frame, "u", "v"])

    return in_frames(part(before, False).union(part(after, True)), frame, found, "u double, v double")
