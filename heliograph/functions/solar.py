"""Solar geometry, clear-sky and photovoltaic physics as column expressions.

Angles are degrees, irradiances W/m2. All functions take and return Columns, so whole models stay in one projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAD = math.pi / 180


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def cosd(x: Column) -> Column:
    return F.cos(x * RAD)


def sind(x: Column) -> Column:
    return F.sin(x * RAD)


def poly(x: Column, *coefficients: float) -> Column:
    """coefficients[0] + coefficients[1] x + ... by Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def positive_mod(x: Column, n: float) -> Column:
    return x - n * F.floor(x / n)


# Spencer's series for the sun's distance, the solar constants of the models, clear-sky bias factors.
SPENCER = (1.00011, 0.034221, 0.00128, 0.000719, 0.000077)
SOLAR_CONSTANT, SOLAR_CONSTANT_DISC = 1367.0, 1370.0


def distance_factor(angle: Column) -> Column:
    a, b, c, d, e = SPENCER
    return a + b * F.cos(angle) + c * F.sin(angle) + d * F.cos(2 * angle) + e * F.sin(2 * angle)


def extraterrestrial(doy: Column) -> Column:
    return SOLAR_CONSTANT * distance_factor(2 * math.pi * doy / 365)


def pressure_of(altitude: Column | float) -> Column:
    return 100 * F.pow((44331.514 - num(altitude)) / 11880.516, F.lit(1 / 0.1902632))


def altitude_of(pressure: Column | float) -> Column:
    return 44331.5 - 4946.62 * F.pow(num(pressure), F.lit(0.190263))


def with_sun_position(df: DataFrame, year: Column, doy: Column, hours_utc: Column, latitude: float | Column, longitude: float | Column, pressure: float | Column = 101325.0, temperature: float | Column = 12.0) -> DataFrame:
    """df with azimuth, elevation, apparent_elevation and solar_time of an instant in UTC; longitude is positive eastwards.

    Kepler's equation takes six fixed iterations, so no row's result depends on other rows. The steps are named columns,
    so that what several later terms use is computed once; the optimizer keeps them apart and joins the rest.
    """
    c = F.col
    mod = lambda x: F.pmod(x, F.lit(360.0))
    step = df.withColumns({"_lat": num(latitude) * RAD, "_hour": F.pmod(hours_utc.cast("double"), F.lit(24.0)), "_mid": 365 * (year - 1900) + F.floor((year - 1901) / 4) - 0.5 + doy + F.floor(hours_utc / 24)})
    step = step.withColumns({"_t0": c("_mid") / 36525, "_epoch": c("_mid") + c("_hour") / 24, "_t": (c("_mid") + c("_hour") / 24) / 36525})
    t, epoch = c("_t"), c("_epoch")
    day = 6 / 24 + 38 / 1440 + poly(c("_t0"), 45.836, 8640184.542, 0.0929) / 86400
    cubes = 0.000003 * t * t * t
    step = step.withColumns({"_local": mod(360 + mod(360 * F.pmod(day, F.lit(1.0)) + 360 * (1.0027379093 * c("_hour") / 24)) + num(longitude)), "_obliquity": poly(t, 23.452294, -0.0130125, -0.00000164, 0.000000503) * RAD, "_anomaly": mod(358.47583 + 0.985600267 * epoch - 0.00015 * t * t - cubes), "_ecc": poly(t, 0.01675104, -0.0000418, -0.000000126)})
    e = c("_anomaly")
    for _ in range(6):
        e = c("_anomaly") + c("_ecc") * F.sin(e * RAD) / RAD
    true = 2 * mod(F.atan(F.sqrt((1 + c("_ecc")) / (1 - c("_ecc"))) * F.tan(e * RAD / 2)) / RAD)
    step = step.withColumn("_ecliptic", (mod(281.22083 + 0.0000470684 * epoch + 0.000453 * t * t + cubes + true) - 20 / 3600) * RAD)
    step = step.withColumns({"_dec": F.asin(F.sin("_obliquity") * F.sin("_ecliptic")), "_angle": c("_local") - F.atan2(F.cos("_obliquity") * F.sin("_ecliptic"), F.cos("_ecliptic")) / RAD})
    h = c("_angle") * RAD
    step = step.withColumns({"_az": F.atan2(-F.sin(h), F.cos("_lat") * F.tan("_dec") - F.sin("_lat") * F.cos(h)) / RAD, "elevation": F.asin(F.cos("_lat") * F.cos("_dec") * F.cos(h) + F.sin("_lat") * F.sin("_dec")) / RAD})
    el = c("elevation")
    step = step.withColumn("_tan", F.tan(el * RAD))
    tan = c("_tan")
    bend = (
        F.when((el > 5) & (el <= 85), 58.1 / tan - 0.07 / F.pow(tan, F.lit(3)) + 0.000086 / F.pow(tan, F.lit(5)))
        .when((el > -0.575) & (el <= 5), poly(el, 1735, -518.2, 103.4, -12.79, 0.711))
        .when((el > -1) & (el <= -0.575), -20.774 / tan)
        .otherwise(0)
    )
    turn = F.when(F.abs(c("_angle")) > 180, 360 * F.signum("_angle")).otherwise(0)
    out = {"azimuth": F.when(c("_az") < 0, c("_az") + 360).otherwise(c("_az")), "elevation": el, "apparent_elevation": el + bend * (283 / (273 + num(temperature))) * num(pressure) / 101325 / 3600, "solar_time": (180 + c("_angle") - turn) / 15}
    return step.select(*[c(x) for x in df.columns], *[v.alias(k) for k, v in out.items()])


# Leading terms of the earth's place (amplitude in 1e-8, phase, rate in a millennium) by power of time.
EARTH = {
    "longitude": [
        [(175347046, 0, 0), (3341656, 4.6692568, 6283.07585), (34894, 4.6261, 12566.1517), (3497, 2.7441, 5753.3849), (3418, 2.8289, 3.5231), (3136, 3.6277, 77713.7715), (2676, 4.4181, 7860.4194), (2343, 6.1352, 3930.2097), (1324, 0.7425, 11506.7698), (1273, 2.0371, 529.691), (1199, 1.1096, 1577.3435), (990, 5.233, 5884.927), (902, 2.045, 26.298), (857, 3.508, 398.149), (780, 1.179, 5223.694)],
        [(628331966747, 0, 0), (206059, 2.678235, 6283.07585), (4303, 2.6351, 12566.1517), (425, 1.59, 3.523), (119, 5.796, 26.298), (109, 2.966, 1577.344)],
        [(52919, 0, 0), (8720, 1.0721, 6283.0758), (309, 0.867, 12566.152)],
    ],
    "latitude": [[(280, 3.199, 84334.662), (102, 5.422, 5507.553), (80, 3.88, 5223.69)]],
    "distance": [[(100013989, 0, 0), (1670700, 3.0984635, 6283.07585), (13956, 3.05525, 12566.1517), (3084, 5.1985, 77713.7715), (1628, 1.1739, 5753.3849), (1576, 2.8469, 7860.4194)], [(103019, 1.10749, 6283.07585), (1721, 1.0644, 12566.1517)]],
}
# Leading terms of nutation (multiples of five angles; sine of longitude, cosine of obliquity, each with its change in a century).
NUTATION = [((0, 0, 0, 0, 1), -171996, -174.2, 92025, 8.9), ((-2, 0, 0, 2, 2), -13187, -1.6, 5736, -3.1), ((0, 0, 0, 2, 2), -2274, -0.2, 977, -0.5), ((0, 0, 0, 0, 2), 2062, 0.2, -895, 0.5), ((0, 1, 0, 0, 0), 1426, -3.4, 54, -0.1)]
# The five angles (elongation, anomalies of sun and moon, moon's argument and node) and the obliquity, by power of time.
ANGLES = [(297.85036, 445267.11148, -0.0019142, 1 / 189474), (357.52772, 35999.05034, -0.0001603, -1 / 300000), (134.96298, 477198.867398, 0.0086972, 1 / 56250), (93.27191, 483202.017538, -0.0036825, 1 / 327270), (125.04452, -1934.136261, 0.0020708, 1 / 450000)]
OBLIQUITY = (84381.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.125, 27.87, 5.79, 2.45)


def with_precise_sun_position(df: DataFrame, days: Column, latitude: float | Column, longitude: float | Column, altitude: float | Column = 0.0, pressure: float | Column = 101325.0, temperature: float | Column = 12.0, delta_t: float | Column | None = None, earth: dict | None = None, nutation: list | None = None) -> DataFrame:
    """df with azimuth, elevation and apparent_elevation by the long series of the earth's path, as seen from a place.

    days: UT days since noon of 2000-01-01; delta_t: seconds of terrestrial time ahead of UT, by default a line through
    2012. The terms given here are the leading ones, within
    0.003 degrees of the published example; earth and nutation take fuller tables in the same form. Sums run
    over literal arrays, so that long tables don't grow the generated code. The parallax is a difference of vectors: the
    sun's less the observer's, in units of the sun's distance. Null inputs give nulls.
    """
    earth, nutation, c = earth or EARTH, nutation or NUTATION, F.col
    if delta_t is None:
        delta_t = 66.3 + 0.6175 * (F.year(F.date_add(F.lit("2000-01-01").cast("date"), F.floor(days + 0.5).cast("int"))) - 2012)

    def total(rows: list, names: str, of) -> Column:
        table = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
        return F.aggregate(table, F.lit(0.0), lambda acc, x: acc + of(x))

    def series(kind: str) -> Column:
        powers = [total(rows, "abc", lambda x: x["a"] * F.cos(x["b"] + x["c"] * c("_jme"))) for rows in earth[kind]]
        out = powers[-1]
        for p in reversed(powers[:-1]):
            out = out * c("_jme") + p
        return out * 1e-8

    step = df.withColumns({"_d": days.cast("double"), "_jce": (days + num(delta_t) / 86400) / 36525, "_lat": num(latitude) * RAD})
    step = step.withColumns({"_jme": c("_jce") / 10, **{f"_x{i}": poly(c("_jce"), *a) for i, a in enumerate(ANGLES)}})
    step = step.withColumns({"_lon": series("longitude"), "_beta": -series("latitude"), "_far": series("distance")})
    rows = [(*n, *rest) for n, *rest in nutation]
    turn = lambda x: (x["u"] * c("_x0") + x["v"] * c("_x1") + x["w"] * c("_x2") + x["x"] * c("_x3") + x["y"] * c("_x4")) * RAD
    step = step.withColumns({"_psi": total(rows, "uvwxyabcd", lambda x: (x["a"] + x["b"] * c("_jce")) * F.sin(turn(x))) / 36e6, "_eps": poly(c("_jme") / 10, *OBLIQUITY) / 3600 + total(rows, "uvwxyabcd", lambda x: (x["c"] + x["d"] * c("_jce")) * F.cos(turn(x))) / 36e6})
    t = c("_d") / 36525
    sidereal = 280.46061837 + 360.98564736629 * c("_d") + 0.000387933 * t * t - t * t * t / 38710000 + c("_psi") * cosd(c("_eps")) + num(longitude)
    step = step.withColumns({"_lambda": c("_lon") + math.pi + (c("_psi") - 20.4898 / (3600 * c("_far"))) * RAD, "_eps": c("_eps") * RAD, "_st": F.pmod(sidereal, F.lit(360.0)) * RAD, "_par": F.sin(8.794 / (3600 * c("_far")) * RAD)})
    east = F.cos("_beta") * F.sin("_lambda")
    step = step.withColumns({"_ex": F.cos("_beta") * F.cos("_lambda"), "_ey": east * F.cos("_eps") - F.sin("_beta") * F.sin("_eps"), "_ez": east * F.sin("_eps") + F.sin("_beta") * F.cos("_eps")})
    flat, high = F.atan(0.99664719 * F.tan("_lat")), num(altitude) / 6378140
    step = step.withColumns({"_hx": c("_ex") * F.cos("_st") + c("_ey") * F.sin("_st") - c("_par") * (F.cos(flat) + high * F.cos("_lat")), "_west": c("_ex") * F.sin("_st") - c("_ey") * F.cos("_st"), "_hz": c("_ez") - c("_par") * (0.99664719 * F.sin(flat) + high * F.sin("_lat"))})
    south = c("_hx") * F.sin("_lat") - c("_hz") * F.cos("_lat")
    step = step.withColumns({"_az": F.pmod(180 + F.atan2(c("_west"), south) / RAD, F.lit(360.0)), "_el": F.atan2(c("_hx") * F.cos("_lat") + c("_hz") * F.sin("_lat"), F.hypot(south, c("_west"))) / RAD})
    el = c("_el")
    bend = num(pressure) / 101000 * 283 / (273 + num(temperature)) * 1.02 / (60 * F.tan((el + 10.3 / (el + 5.11)) * RAD))
    seen = F.when(el >= -(0.26667 + 0.5667), el + bend).otherwise(el)  # the sun's radius, and refraction at the horizon
    return step.select(*[c(x) for x in df.columns], c("_az").alias("azimuth"), el.alias("elevation"), seen.alias("apparent_elevation"))


def relative_airmass(zenith: Column) -> Column:
    """Kasten and Young 1989; null beyond the horizon."""
    return F.when(zenith <= 90, 1 / (cosd(zenith) + 0.50572 * F.pow(6.07995 + (90 - zenith), F.lit(-1.6364))))


def absolute_airmass(relative: Column, pressure: Column | float) -> Column:
    return relative * num(pressure) / 101325


def haurwitz(zenith: Column) -> Column:
    c = cosd(zenith)
    return F.when(c > 0, 1098 * c * F.exp(-0.059 / c)).otherwise(0.0)


def ineichen(doy: Column, zenith: Column, airmass: Column, altitude: Column | float, turbidity: Column | float) -> dict[str, Column]:
    """ghi, dni, dhi of a clear sky; zenith is the apparent one, airmass absolute; 0 without sun."""
    alt, tl, i0, c = num(altitude), num(turbidity), extraterrestrial(doy), cosd(zenith)
    f1, f2 = F.exp(-alt / 8000), F.exp(-alt / 1250)
    up, down = 0.0000509 * alt + 0.868, 0.0000392 * alt + 0.0387
    ghi = up * i0 * c * F.exp(-down * airmass * (f1 + f2 * (tl - 1))) * F.exp(0.01 * F.pow(airmass, F.lit(1.8)))
    ghi = F.coalesce(F.greatest(ghi, F.lit(0.0)), F.lit(0.0))
    beam = (0.664 + 0.163 / f1) * i0 * F.exp(-0.09 * airmass * (tl - 1))
    dni = F.coalesce(F.when(c > 0, F.least(beam, ghi * (1 - (0.1 - 0.2 * F.exp(-tl)) / (0.1 + 0.882 / f1)) / c)), F.lit(0.0))
    return {"ghi": ghi, "dni": dni, "dhi": ghi - dni * c}


def incidence(tilt: Column | float, azimuth: Column | float, zenith: Column, sun_azimuth: Column) -> Column:
    """Angle between the sun and a surface's normal."""
    t = num(tilt)
    c = cosd(zenith) * cosd(t) + sind(t) * sind(zenith) * cosd(sun_azimuth - num(azimuth))
    return F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))) / RAD


# ---- global to diffuse and direct ---------------------------------------------------------------


def clearness(ghi: Column, zenith: Column, doy: Column) -> Column:
    return F.greatest(ghi / (extraterrestrial(doy) * cosd(zenith)), F.lit(0.0))


def diffuse_fraction(model: str, kt: Column, zenith: Column) -> Column:
    """erbs, orgill_hollands, reindl_1 or reindl_2."""
    if model == "erbs":
        return F.when(kt > 0.8, 0.165).when(kt > 0.22, poly(kt, 0.9511, -0.1604, 4.3888, -16.638, 12.336)).otherwise(1 - 0.09 * kt)
    low, high, parts = {
        "orgill_hollands": (0.35, 0.75, (1 - 0.249 * kt, 1.577 - 1.84 * kt, F.lit(0.177))),
        "reindl_1": (0.30, 0.78, (1.02 - 0.248 * kt, 1.45 - 1.67 * kt, F.lit(0.147))),
        "reindl_2": (0.30, 0.78, (1.02 - 0.254 * kt + 0.0123 * sind(zenith), 1.4 - 1.749 * kt + 0.177 * sind(zenith), 0.486 * kt - 0.182 * sind(zenith))),
    }[model]
    return F.when(kt <= low, parts[0]).when(kt < high, parts[1]).otherwise(parts[2])


def split_global(model: str, ghi: Column, zenith: Column, doy: Column) -> tuple[Column, Column]:
    """(dhi, dni) by a diffuse fraction model."""
    dhi = diffuse_fraction(model, clearness(ghi, zenith, doy), zenith) * ghi
    return dhi, (ghi - dhi) / cosd(zenith)


def louche_dni(ghi: Column, zenith: Column, doy: Column) -> Column:
    return poly(clearness(ghi, zenith, doy), 0.002, -0.059, 0.994, -5.205, 15.307, -10.627) * extraterrestrial(doy)


def kasten_mass(zenith: Column, pressure: Column | float = 101325.0) -> Column:
    """Air mass by Kasten's formula of 1966, at a pressure in Pa."""
    return 1 / (cosd(zenith) + 0.15 * F.pow(93.885 - zenith, F.lit(-1.253))) * num(pressure) / 101325


def disc_clearness(ghi: Column, zenith: Column, doy: Column) -> Column:
    """Share of the extraterrestrial irradiance that reaches the ground, as DISC takes it."""
    i0 = SOLAR_CONSTANT_DISC * distance_factor(2 * math.pi * (doy - 1) / 365)
    return F.greatest(ghi / (i0 * cosd(zenith)), F.lit(0.0))


def clearness_prime(ghi: Column, zenith: Column, doy: Column, pressure: Column | float = 101325.0) -> Column:
    """The clearness of Perez and others that hardly depends on the zenith, up to 0.82."""
    am = kasten_mass(zenith, pressure)
    return F.least(F.lit(0.82), disc_clearness(ghi, zenith, doy) / (1.031 * F.exp(-1.4 / (0.9 + 9.4 / am)) + 0.1))


#: Lower ends of DIRINT's classes of clearness, zenith, change of clearness and precipitable water.
DIRINT_KT, DIRINT_ZENITH = (0.0, 0.24, 0.4, 0.56, 0.7, 0.8), (0.0, 25.0, 40.0, 55.0, 70.0, 80.0)
DIRINT_CHANGE, DIRINT_WATER = (0.0, 0.015, 0.035, 0.07, 0.15, 0.3), (0.0, 1.0, 2.0, 3.0)


def class_of(value: Column, lower: tuple[float, ...]) -> Column:
    """Number (from 1) of the class whose lower end value reaches; 0 below the first, null for null."""
    return F.when(value.isNotNull(), sum(((value >= x).cast("int") for x in lower), F.lit(0)))


def disc_dni(ghi: Column, zenith: Column, doy: Column, pressure: Column | float = 101325.0) -> Column:
    i0 = SOLAR_CONSTANT_DISC * distance_factor(2 * math.pi * (doy - 1) / 365)
    am = kasten_mass(F.least(zenith, F.lit(87.0)), pressure)
    kt = disc_clearness(ghi, zenith, doy)
    pick = lambda high, low: F.when(kt > 0.6, poly(kt, *high)).otherwise(poly(kt, *low))
    a = pick((-5.743, 21.77, -27.49, 11.56), (0.512, -1.56, 2.286, -2.222))
    b = pick((41.4, -118.5, 66.05, 31.9), (0.37, 0.962))
    c = pick((-47.01, 184.2, -222.0, 73.81), (-0.28, 0.932, -2.048))
    dni = (poly(am, 0.866, -0.122, 0.0121, -0.000653, 0.000014) - (a + b * F.exp(c * am))) * i0
    return F.when((zenith > 87) | (ghi < 1) | (dni < 0), 0.0).otherwise(dni)


# ---- tilted surfaces ----------------------------------------------------------------------------


def isotropic_diffuse(tilt: Column | float, dhi: Column) -> Column:
    return dhi * (1 + cosd(num(tilt))) / 2


def king_diffuse(tilt: Column | float, dhi: Column, ghi: Column, zenith: Column) -> Column:
    return dhi * (1 + cosd(num(tilt))) / 2 + ghi * (0.012 * zenith - 0.04) * (1 - cosd(num(tilt))) / 2


def hay_davies_diffuse(tilt: Column | float, azimuth: Column | float, dhi: Column, dni: Column, extra: Column, zenith: Column, sun_azimuth: Column) -> Column:
    t = num(tilt)
    c = cosd(t) * cosd(zenith) + sind(t) * sind(zenith) * cosd(sun_azimuth - num(azimuth))
    beam = F.greatest(c, F.lit(0.0)) / F.greatest(cosd(zenith), F.lit(0.01745))
    share = dni / extra
    return dhi * (share * beam + (1 - share) * 0.5 * (1 + cosd(t)))


def ground_diffuse(tilt: Column | float, ghi: Column, albedo: Column | float = 0.2) -> Column:
    return ghi * num(albedo) * (1 - cosd(num(tilt))) * 0.5


def iam_ashrae(b: float, angle: Column) -> Column:
    m = 1 - b * (1 / cosd(angle) - 1)
    return F.when((F.abs(angle) > 90) | (m > 1) | (m < 0), 0.0).otherwise(m)


def iam_martin_ruiz(ar: float, angle: Column) -> Column:
    m = (1 - F.exp(-cosd(angle) / ar)) / (1 - math.exp(-1 / ar))
    return F.when((F.abs(angle) > 90) | (m < 0), 0.0).otherwise(m)


# ---- modules and inverters ----------------------------------------------------------------------


def cell_temperature(e: Column, wind: Column, ambient: Column, a: float, b: float, dt: float, e0: float = 1000.0) -> tuple[Column, Column]:
    """(cell, module) temperatures of the Sandia array model."""
    module = e * F.exp(a + b * wind) + ambient
    return module + e / e0 * dt, module


def desoto(s: Column, cell: Column, alpha: float, ref: dict[str, float], gap: float = 1.121, gap_slope: float = -0.0002677, m: float = 1.0, s0: float = 1000.0, t0: float = 25.0) -> dict[str, Column]:
    """Single-diode parameters il, i0, rs, rsh, nnsvth; ref: a, il, i0, rsh, rs. 8.617332478e-5: Boltzmann's constant in eV/K."""
    k, tk, t0k = 8.617332478e-5, cell + 273.15, t0 + 273.15
    eg = gap * (1 + gap_slope * (tk - t0k))
    il = F.when(s > 0, s / s0 * m * (ref["il"] + alpha * (tk - t0k))).otherwise(0.0)
    i0 = F.when(il == 0, 0.0).otherwise(ref["i0"] * F.pow(tk / t0k, F.lit(3)) * F.exp(gap / (k * t0k) - eg / (k * tk)))
    return {"il": il, "i0": i0, "rs": F.lit(float(ref["rs"])), "rsh": F.when(s > 0, ref["rsh"] * (s0 / s)).otherwise(float("inf")), "nnsvth": ref["a"] * (tk / t0k)}


def diode_current(v: Column, p: dict[str, Column], rounds: int = 30) -> Column:
    """Current of the single-diode equation at voltage v by fixed Newton steps; all in one expression of arrays."""
    s = F.struct(v.cast("double").alias("v"), *[p[k].cast("double").alias(k) for k in ("il", "i0", "rs", "rsh", "nnsvth")])

    def step(i: Column, x: Column) -> Column:
        e = F.exp((x["v"] + i * x["rs"]) / x["nnsvth"])
        f = x["il"] - x["i0"] * (e - 1) - (x["v"] + i * x["rs"]) / x["rsh"] - i
        return i - f / (-x["i0"] * e * x["rs"] / x["nnsvth"] - x["rs"] / x["rsh"] - 1)

    return F.aggregate(F.array_repeat(s, rounds), p["il"].cast("double"), step)


def snl_inverter(vdc: Column, pdc: Column, p: dict[str, float]) -> Column:
    """AC power of the Sandia inverter model; p: pac0, pdc0, vdc0, ps0, c0, c1, c2, c3, pnt."""
    dv = vdc - p["vdc0"]
    a, b, c = p["pdc0"] * (1 + p["c1"] * dv), p["ps0"] * (1 + p["c2"] * dv), p["c0"] * (1 + p["c3"] * dv)
    ac = (p["pac0"] / (a - b) - c * (a - b)) * (pdc - b) + c * (pdc - b) * (pdc - b)
    return F.when(ac > p["pac0"], p["pac0"]).when(ac < p["ps0"], -abs(p["pnt"])).otherwise(ac)


def diffuse_sensor(ghi: Column, dni: Column, angle: Column, sun_flag: Column) -> Column:
    """Diffuse part of a global reading: the direct one counts by the sun's flag (1: hidden, 4: clear; others unknown)."""
    return ghi - dni * cosd(angle) * F.when(sun_flag == 1, 0.0).when(sun_flag == 4, 1.0)


def reconstruct(dni: Column, dhi: Column, zenith: Column, tilted: bool = False) -> Column:
    """Global irradiance on the horizontal or the tilted sensor from its parts. Fitted gains."""
    a, b = (1.0, 0.78) if tilted else (0.9, 1.14)
    return a * cosd(zenith) * dni + b * dhi


def clear_power_curve(doy: Column, relative: Column) -> Column:
    """Share of peak power of a clear day at a share of its peak irradiance. Fitted coefficients."""
    season = F.cos(positive_mod(doy - 1 + 11 - 183, 365) / 183 * math.pi)
    d = 1 - relative
    c = [p + q * season for p, q in ((0.8535, 0.1342), (0.2364, 0.1374), (0.0227, -0.2178))]
    return F.greatest(0.5 * relative, 1 - c[0] * d - c[1] * d * d - c[2] * d * d * d)


def adr_inverter(vdc: Column, pdc: Column, p: dict) -> Column:
    """AC power by the loss model of Driesse, Jain and Harrison: losses are quadratic in power, and linear in voltage and in
    its inverse. p: pnom, vnom, pacmax, pnt and the nine coefficients b."""
    u, v = pdc / p["pnom"], vdc / p["vnom"]
    terms = [F.pow(u, F.lit(float(i))) * c for c in (F.lit(1.0), v - 1, F.try_divide(F.lit(1.0), v) - 1) for i in range(3)]
    loss = sum((b * t for b, t in zip(p["b"], terms, strict=True)), F.lit(0.0))
    ac = p["pnom"] * (u - loss)
    night = -abs(p["pnt"])
    return F.when((vdc == 0) | (ac < night), night).otherwise(F.least(ac, F.lit(float(p["pacmax"]))))


def with_single_axis(df: DataFrame, zenith: str, azimuth: str, axis_tilt: float = 0.0, axis_azimuth: float = 180.0, most: float = 90.0, cover: float | None = None) -> DataFrame:
    """df with theta, incidence, surface_tilt, surface_azimuth of a tracker that turns about one axis of any tilt, in degrees;
    null while the sun is down. cover, the share of the ground that rows cover, turns rows back so that none shades the next."""
    t, o = math.radians(axis_tilt), math.radians(axis_azimuth - 180)
    z, a, bound = F.radians(zenith), F.radians(F.col(azimuth) - 180), lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    d = df.withColumns({"_x": F.sin(z) * F.sin(a), "_y": F.sin(z) * F.cos(a), "_up": F.cos(z)})
    x, y, up = F.col("_x"), F.col("_y"), F.col("_up")
    d = d.withColumns({"_xp": x * math.cos(o) - y * math.sin(o), "_zp": x * math.sin(t) * math.sin(o) + y * math.sin(t) * math.cos(o) + up * math.cos(t)})  # across the axis, and away from it
    d = d.withColumn("_wide", F.atan2("_xp", "_zp"))
    if cover is not None:
        d = d.withColumn("_back", F.acos(bound(F.cos("_wide") / cover))).withColumn("_wide", F.when(F.col("_wide") < 0, F.col("_wide") + F.col("_back")).otherwise(F.col("_wide") - F.col("_back"))).drop("_back")
    d = d.withColumn("_theta", F.greatest(F.lit(-math.radians(most)), F.least(F.lit(math.radians(most)), F.col("_wide")))).withColumns({"_nx": F.sin("_theta"), "_nz": F.cos("_theta")})
    nx, nz = F.col("_nx"), F.col("_nz")
    d = d.withColumn("_turn", F.degrees(F.atan2(nx * math.cos(o) + nz * math.sin(t) * math.sin(o), -nx * math.sin(o) + nz * math.sin(t) * math.cos(o))) + 180)
    up_now = F.col(zenith) < 90
    out = {"theta": F.degrees("_theta"), "incidence": F.degrees(F.acos(bound(F.abs(F.col("_xp") * nx + F.col("_zp") * nz)))), "surface_tilt": F.degrees(F.acos(bound(nz * math.cos(t)))), "surface_azimuth": F.col("_turn") - 360 * F.floor(F.col("_turn") / 360)}
    return d.withColumns({k: F.when(up_now, c) for k, c in out.items()}).drop("_x", "_y", "_up", "_xp", "_zp", "_wide", "_theta", "_nx", "_nz", "_turn")


def tracker_angle(zenith: Column, azimuth: Column, axis_azimuth: float, most: float = 90.0) -> Column:
    """Rotation (degrees, positive to the west of a north-south axis seen from the south) of a horizontal single-axis tracker
    that points its modules at the sun as far as its stops allow; null at night."""
    z, a = F.radians(zenith), F.radians(azimuth - axis_azimuth)
    return F.when(zenith < 90, F.greatest(F.lit(-most), F.least(F.lit(most), F.degrees(F.atan2(F.sin(z) * F.sin(a), F.cos(z))))))


def sapm(ee: Column, cell: Column, p: dict[str, float], t0: float = 25.0) -> dict[str, Column]:
    """Five points of the current-voltage curve (isc, imp, voc, vmp, pmp, ix, ixx) by the Sandia array model, at effective
    irradiance ee (suns) and cell temperature; 0 below a thousandth of a sun.

    p: isc0, imp0, voc0, vmp0, ix0, ixx0, aisc, aimp, bvoc, mbvoc, bvmp, mbvmp, n, ns and c0 to c7. 8.617332478e-5:
    Boltzmann's constant over the elementary charge.
    """
    dt, e = cell - t0, F.greatest(ee, F.lit(1e-3))
    delta = p["n"] * 8.617332478e-5 * (cell + 273.15)
    fall = delta * F.log(e)
    out = {
        "isc": p["isc0"] * e * (1 + p["aisc"] * dt),
        "imp": p["imp0"] * (p["c0"] * e + p["c1"] * e * e) * (1 + p["aimp"] * dt),
        "voc": p["voc0"] + p["ns"] * fall + (p["bvoc"] + p["mbvoc"] * (1 - e)) * dt,
        "vmp": p["vmp0"] + p["c2"] * p["ns"] * fall + p["c3"] * p["ns"] * fall * fall + (p["bvmp"] + p["mbvmp"] * (1 - e)) * dt,
        "ix": p["ix0"] * (p["c4"] * e + p["c5"] * e * e) * (1 + p["aisc"] * dt),
        "ixx": p["ixx0"] * (p["c6"] * e + p["c7"] * e * e) * (1 + p["aisc"] * dt),
    }
    out["pmp"] = out["imp"] * out["vmp"]
    return {k: F.when(ee >= 1e-3, c).when(ee.isNotNull(), 0.0) for k, c in out.items()}
