"""Scalar and vector functions as column expressions: ranges, bins, response curves, histogram distances, geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_map(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """x from [low, high] to [to_low, to_high]; null where the range is empty."""
    return F.when(high != low, to_low + (to_high - to_low) * (x - low) / (high - low))


def ceil_bin(x: Column, width: float) -> Column:
    return width * F.ceil(x / width)


def quantise(x: Column, low: float, high: float, n: int) -> Column:
    """Level 1..n of x in [low, high], clamped."""
    return F.greatest(F.lit(1), F.least(F.lit(n), F.floor((x - low) / (high - low) * n) + 1))


def log_ratio(a: Column, b: Column, limit: float = 6.0) -> Column:
    """log2(a / b) within +-limit; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log2(a / b))))


def cover_to_power(x: Column) -> list[Column]:
    """Power shares of a cloud cover x in [0, 1]: linear, exponential and sigmoid response."""
    return [1 - x, 1 + (1 - F.exp(x)) / (math.e - 1), (1 - F.tanh(4 * (x - 0.5)) / math.tanh(2)) / 2]


def clear_score(value: Column, clear: Column, low: float, high: float) -> Column:
    """-3 (cloudy) to 1 (clear) from the ratio of a value to its clear-sky value."""
    return 2 * F.tanh(6 * (value / clear - low) / (high - low) - 3) - 1


def minkowski(x: Column, y: Column, p: float) -> Column:
    total = F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(0.0), lambda s, v: s + v)
    return F.pow(total, F.lit(1 / p))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _cumulative(x: Column) -> Column:
    return F.transform(x, lambda _, i: _sum(F.slice(x, 1, i + 1)))


def histogram_distances(x: Column, y: Column) -> dict[str, Column]:
    """Distances of two histograms (arrays of doubles of equal length); bins empty in both count nothing."""
    mid = lambda f: _sum(F.zip_with(x, y, lambda a, b: F.when(a + b == 0, 0.0).otherwise(f(a, b))))
    xlog = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    jeffrey = mid(lambda a, b: xlog(a, (a + b) / 2) + xlog(b, (a + b) / 2))
    gaps = F.zip_with(_cumulative(x), _cumulative(y), lambda a, b: F.abs(a - b))
    return {
        "chi_square": mid(lambda a, b: (a - (a + b) / 2) * (a - (a + b) / 2) / ((a + b) / 2)),
        "jeffrey": jeffrey,
        "jensen_shannon": jeffrey / 2,
        "kullback_leibler": _sum(F.zip_with(x, y, lambda a, b: F.when(a == 0, 0.0).otherwise(a * F.log(a / b)))),
        "intersection": 1 - _sum(F.zip_with(x, y, lambda a, b: F.least(a, b))) / _sum(x),
        "match": _sum(gaps),
        "kolmogorov_smirnov": F.array_max(gaps),
        "bhattacharyya": F.sqrt(F.greatest(F.lit(0.0), 1 - _sum(F.zip_with(x, y, lambda a, b: F.sqrt(a * b))) / F.sqrt(_sum(x) * _sum(y)))),
    }


def quadratic_form(x: Column, y: Column, likeness: list[list[float]]) -> Column:
    """sqrt(d A d') of d = x - y and a fixed matrix of bin likeness."""
    d = F.zip_with(x, y, lambda a, b: a - b)
    rows = [_sum(F.zip_with(d, F.array(*map(F.lit, r)), lambda a, b: a * b)) for r in likeness]
    return F.sqrt(_sum(F.zip_with(d, F.array(*rows), lambda a, b: a * b)))


def simplex_projection(x: Column) -> Column:
    """The nearest point of the probability simplex to an array of doubles."""
    u = F.reverse(F.array_sort(x))
    shift = F.transform(u, lambda _, i: (1 - _sum(F.slice(u, 1, i + 1))) / (i + 1))
    ok = F.filter(F.zip_with(u, shift, lambda a, s: F.when(a + s > 0, s)), lambda s: s.isNotNull())
    return F.transform(x, lambda v: F.greatest(v + F.element_at(ok, -1), F.lit(0.0)))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Crossing-number test against a fixed polygon, behind its bounding box."""
    xs, ys = zip(*corners, strict=True)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            crossings = crossings + (((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def to_cartesian(azimuth: Column, elevation: Column) -> list[Column]:
    a, e = F.radians(azimuth), F.radians(elevation)
    return [F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)]


def vector_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit vectors."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def camera_ray(row: Column, col: Column, centre: tuple[float, float], affine: tuple[float, float, float], shape: list[float]) -> list[Column]:
    """Unit ray of a pixel of an omnidirectional camera: affine c, d, e undone, then a polynomial of the radius for z."""
    c, d, e = affine
    det = c - d * e
    u, v = row - centre[0], col - centre[1]
    x, y = (u - d * v) / det, (c * v - e * u) / det
    r = F.sqrt(x * x + y * y)
    z = F.lit(float(shape[-1]))
    for s in reversed(shape[:-1]):
        z = z * r + float(s)
    n = F.sqrt(x * x + y * y + z * z)
    return [x / n, y / n, z / n]


def camera_pixel(ray: tuple[Column, Column, Column], centre: tuple[float, float], affine: tuple[float, float, float], inverse: list[float]) -> tuple[Column, Column]:
    """(row, column) where an omnidirectional camera sees a ray (x, y, z): the radius is a polynomial (lowest power first)
    of the angle to the image plane, then the affine c, d, e applies. A ray along the axis is the centre."""
    x, y, z = ray
    n = F.sqrt(x * x + y * y)
    angle = F.atan2(z, n)
    rho = F.lit(float(inverse[-1]))
    for p in reversed(inverse[:-1]):
        rho = rho * angle + float(p)
    u, v = (F.when(n > 0, k / n * rho).when(n == 0, 0.0) for k in (x, y))
    c, d, e = affine
    return u * c + v * d + centre[0], u * e + v + centre[1]


def on_plane(ray: tuple[Column, Column, Column], height: float) -> tuple[Column, Column]:
    """Where a ray (x, y, z) from the origin meets the plane z = height; null if it doesn't."""
    x, y, z = ray
    k = F.when(z * height > 0, height / z)
    return k * x, k * y
