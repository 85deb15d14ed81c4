"""Photogrammetric expressions: rotations, collinearity, distortion, rational functions, map projection."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def rotation(omega: Column, phi: Column, kappa: Column) -> list[list[Column]]:
    """Rows of the ground-to-camera matrix Rz(kappa) Ry(phi) Rx(omega), each turn positive about its axis."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    return [
        [cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck],
        [-cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk],
        [sp, -so * cp, co * cp],
    ]


def to_camera(ground: list[Column], centre: list[Column], angles: list[Column]) -> list[Column]:
    d = [g - c for g, c in zip(ground, centre, strict=True)]
    return [r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in rotation(*angles)]


def project(ground: list[Column], centre: list[Column], angles: list[Column], focal: Column) -> tuple[Column, Column]:
    """Film coordinates of a ground point; null where it lies in the plane of the lens."""
    u, v, w = to_camera(ground, centre, angles)
    w = F.when(F.abs(w) >= 1e-9, w)
    return -focal * u / w, -focal * v / w


def radial(r2: Column, k: list[float]) -> Column:
    """Radial factor 1 + k0 + k1 r^2 + k2 r^4 + .. ."""
    total = F.lit(0.0)
    for c in reversed(k):
        total = total * r2 + F.lit(float(c))
    return 1 + total


def remove_distortion(x: Column, y: Column, k: list[float], x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    dx, dy = x - x0, y - y0
    f = radial(dx * dx + dy * dy, k)
    return dx * f, dy * f


def apply_distortion(x: Column, y: Column, k: list[float], x0: float = 0.0, y0: float = 0.0, steps: int = 8) -> tuple[Column, Column]:
    """Inverse of ``remove_distortion`` by fixed-point steps; the state is one struct, so the plan does not grow with the steps."""
    start = F.struct(x.alias("x"), y.alias("y"))

    def step(s, _):
        f = radial(s["x"] * s["x"] + s["y"] * s["y"], k)
        return F.struct((x / f).alias("x"), (y / f).alias("y"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return done["x"] + x0, done["y"] + y0


LENS_PARAMETERS = ("dx0", "dy0", "df", "k1", "k2", "k3", "p1", "p2", "b1", "b2")


def self_calibration(x: Column, y: Column, values: dict[str, float], focal: float, radius: float) -> tuple[Column, Column]:
    """Film corrections of ten lens parameters: principal point, focal length, three radial, two decentring, two of shape.

    Radial and decentring terms are those of coordinates over ``radius``, so that all parameters are of one size.
    """
    unknown = set(values) - set(LENS_PARAMETERS)
    if unknown:
        raise ValueError(f"no such lens parameters: {', '.join(sorted(unknown))}")
    v = {n: float(values.get(n) or 0.0) for n in LENS_PARAMETERS}
    a, b = x / radius, y / radius
    r2 = a * a + b * b
    grow = v["df"] / focal + r2 * (v["k1"] + r2 * (v["k2"] + r2 * v["k3"]))
    off_x = v["p1"] * (3 * a * a + b * b) + 2 * v["p2"] * a * b
    off_y = v["p2"] * (a * a + 3 * b * b) + 2 * v["p1"] * a * b
    return v["dx0"] + x * grow + radius * off_x + v["b1"] * x + v["b2"] * y, v["dy0"] + y * grow + radius * off_y


def affine(col: Column, row: Column, t: list[float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel centre under a transform ``a, b, c, d, e, f``."""
    a, b, c, d, e, f = t
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def affine_inverse(x: Column, y: Column, t: list[float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det - 0.5, (a * (y - f) - d * (x - c)) / det - 0.5


def homography(col: Column, row: Column, h: list[float]) -> tuple[Column, Column]:
    w = h[6] * col + h[7] * row + h[8]
    return (h[0] * col + h[1] * row + h[2]) / w, (h[3] * col + h[4] * row + h[5]) / w


def parabola_peak(before: Column, at: Column, after: Column) -> Column:
    """Place of the peak through three equally spaced values, within half a step; 0 where they are level."""
    bend = before - 2 * at + after
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (before - after) / (2 * bend))))


def cubic_terms(x: Column, y: Column, z: Column) -> list[Column]:
    """The twenty terms of a rational cubic in the order of the RPC00B format (x longitude, y latitude, z height)."""
    return [F.lit(1.0), *_beyond_one(x, y, z)]


def _beyond_one(x, y, z) -> list:
    return [x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x**3, x * y * y, x * z * z, x * x * y, y**3, y * z * z, x * x * z, y * y * z, z**3]


def rpc_forward(lon: Column, lat: Column, height: Column, model: dict) -> tuple[Column, Column]:
    """Sample and line of a rational function model: offsets, scales, and four lists of twenty coefficients."""
    return _rational(lon, lat, height, model, F.lit(1.0))


def _rational(lon, lat, height, model: dict, one) -> tuple:
    """``rpc_forward`` on columns or on arrays of numbers."""
    x = (lon - model["long_off"]) / model["long_scale"]
    y = (lat - model["lat_off"]) / model["lat_scale"]
    z = (height - model["height_off"]) / model["height_scale"]
    terms = [one, *_beyond_one(x, y, z)]
    poly = lambda c: reduce(lambda s, p: s + p, [t * float(v) for t, v in zip(terms, c, strict=True)])
    line = poly(model["line_num"]) / poly(model["line_den"])
    sample = poly(model["samp_num"]) / poly(model["samp_den"])
    return sample * model["samp_scale"] + model["samp_off"], line * model["line_scale"] + model["line_off"]


def rpc_inverse(sample: Column, line: Column, height: Column, model: dict, steps: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel at a height, by Newton steps with differences, over a batch of rows at once; null where there is none.

    A step needs the model at three places, and each of them several times: as a column expression it would be worked out anew wherever it is named.
    """
    ship_package(SparkSession.active())
    names = ("long_off", "long_scale", "lat_off", "lat_scale", "height_off", "height_scale", "line_num", "line_den", "samp_num", "samp_den", "line_off", "line_scale", "samp_off", "samp_scale")
    m = {k: [float(v) for v in model[k]] if isinstance(model[k], (list, tuple)) else float(model[k]) for k in names}

    @F.pandas_udf("lon double, lat double")
    def solved(sample: pd.Series, line: pd.Series, height: pd.Series) -> pd.DataFrame:
        u, v, h = (c.to_numpy(float, na_value=np.nan) for c in (sample, line, height))
        ds, dl = 1e-5 * m["long_scale"], 1e-5 * m["lat_scale"]
        lon, lat = np.full(len(u), m["long_off"]), np.full(len(u), m["lat_off"])
        with np.errstate(all="ignore"):
            for _ in range(steps):
                a, b = _rational(lon, lat, h, m, 1.0)
                ax, bx = _rational(lon + ds, lat, h, m, 1.0)
                ay, by = _rational(lon, lat + dl, h, m, 1.0)
                p, q, r, t = (ax - a) / ds, (ay - a) / dl, (bx - b) / ds, (by - b) / dl
                det = p * t - q * r
                det = np.where(np.abs(det) > 1e-30, det, np.nan)
                ra, rb = u - a, v - b
                lon, lat = lon + (t * ra - q * rb) / det, lat + (p * rb - r * ra) / det
        return pd.DataFrame({"lon": lon, "lat": lat}).astype("Float64")

    done = solved(sample.cast("double"), line.cast("double"), height.cast("double"))
    return done["lon"], done["lat"]


# Semi-major axis and flattening of the ellipsoids that the presets name.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563),
    "GRS80": (6378137.0, 1 / 298.257222101),
    "WGS72": (6378135.0, 1 / 298.26),
    "Clarke1880": (6378249.145, 1 / 293.4663077),
    "Clarke1866": (6378206.4, 1 / 294.9786982),
    "Bessel1841": (6377397.155, 1 / 299.1528128),
    "Airy1830": (6377563.396, 1 / 299.3249646),
    "International1924": (6378388.0, 1 / 297.0),
}


def _series(n: float) -> tuple[list[float], list[float]]:
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return forward, inverse


def transverse_mercator(lon: Column, lat: Column, central: float, scale: float = 1.0, east: float = 0.0, north: float = 0.0, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the fourth order."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    p, q = F.radians(lat), F.radians(lon - central)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(q)), F.asinh(F.sin(q) / F.sqrt(t * t + F.cos(q) * F.cos(q)))
    x, y = eta, xi
    for k, c in enumerate(_series(n)[0], 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return east + scale * radius * x, north + scale * radius * y


def transverse_mercator_inverse(x: Column, y: Column, central: float, scale: float = 1.0, east: float = 0.0, north: float = 0.0, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing; the latitude by six steps from the conformal one."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi0, eta0 = (y - north) / (scale * radius), (x - east) / (scale * radius)
    xi, eta = xi0, eta0
    for k, c in enumerate(_series(n)[1], 1):
        xi = xi - c * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - c * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    q = F.atanh(F.sin(chi))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), chi, lambda s, _: F.asin(F.tanh(q + e * F.atanh(e * F.sin(s)))))
    return central + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def quaternion(r: list[list[Column]]) -> list[Column]:
    """w, x, y, z of a rotation matrix, w not negative, by the greatest of the four."""
    tr = r[0][0] + r[1][1] + r[2][2]
    parts = [tr, r[0][0], r[1][1], r[2][2]]
    best = F.greatest(*parts)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(1e-300))) * 2
    s0, s1 = root(1 + tr), root(1 + r[0][0] - r[1][1] - r[2][2])
    s2, s3 = root(1 + r[1][1] - r[0][0] - r[2][2]), root(1 + r[2][2] - r[0][0] - r[1][1])
    dx, dy, dz = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    xy, xz, yz = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    pick = lambda w, x, y, z: F.when(best == parts[0], w).when(best == parts[1], x).when(best == parts[2], y).otherwise(z)
    q = [pick(s0 / 4, dx / s1, dy / s2, dz / s3), pick(dx / s0, s1 / 4, xy / s2, xz / s3), pick(dy / s0, xy / s1, s2 / 4, yz / s3), pick(dz / s0, xz / s1, yz / s2, s3 / 4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [sign * v for v in q]


def robust_weight(residual: Column, loss: str = "soft_l1", scale: float = 1.0) -> Column:
    z = (residual / scale) * (residual / scale)
    return {"linear": F.lit(1.0) + 0 * z, "soft_l1": 1 / F.sqrt(1 + z), "cauchy": 1 / (1 + z)}[loss]


def robust_cost(residual: Column, loss: str = "soft_l1", scale: float = 1.0) -> Column:
    z = (residual / scale) * (residual / scale)
    return {"linear": z, "soft_l1": 2 * (F.sqrt(1 + z) - 1), "cauchy": F.log1p(z)}[loss] * (scale * scale)


def radial_shift(r: Column, focal: float, height: float, ground: float, refraction: float | None = None, earth: float = 6_371_000.0) -> Column:
    """Shift of a film radius by refraction (its constant given) and by the curvature of the earth."""
    above = height - ground
    curved = above * r * r * r / (2 * earth * focal * focal)
    return -curved if refraction is None else refraction * (r + r * r * r / (focal * focal)) - curved


def refraction_constant(camera: float, ground: float, nodes: int = 401) -> float:
    """Photogrammetric refraction constant of the standard atmosphere between two heights, by the trapezoid rule."""
    if camera <= ground:
        return 0.0
    step = (camera - ground) / (nodes - 1)

    def refractivity(h: float) -> float:
        kelvin = 288.15 - 0.0065 * min(h, 11_000.0)
        pressure = 1013.25 * (kelvin / 288.15) ** 5.25588
        if h > 11_000.0:
            pressure *= math.exp(-(h - 11_000.0) * 9.80665 / (287.053 * kelvin))
        return 77.6e-6 * pressure / kelvin

    top = refractivity(camera)
    total = 0.0
    for k in range(nodes):
        h = ground + k * step
        total += (0.5 if k in (0, nodes - 1) else 1.0) * (refractivity(h) - top) * step
    return total / (camera - ground)


def geocentric(lon: Column, lat: Column, height: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column, Column]:
    """Geocentric metres of a place in degrees and metres over the ellipsoid."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2 - f)
    u, v = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(u) * F.sin(u))
    return (n + height) * F.cos(u) * F.cos(v), (n + height) * F.cos(u) * F.sin(v), (n * (1 - e2) + height) * F.sin(u)


def geographic(x: Column, y: Column, z: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column, Column]:
    """Degrees and height of a geocentric place: Bowring's formula, used twice (under a micrometre off up to satellites).

    The state is one struct, so the place is worked out once however often the formula names it.
    """
    a, f = ELLIPSOIDS[ellipsoid]
    b, e2 = a * (1 - f), f * (2 - f)
    start = F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.hypot(x, y).alias("p"), (z * a).alias("s"), (F.hypot(x, y) * b).alias("c"))

    def step(t, _):
        n = F.hypot(t["s"], t["c"])  # sine and cosine of the reduced latitude, up to a factor
        up, out = t["z"] + e2 / (1 - e2) * b * F.pow(t["s"] / n, 3), t["p"] - e2 * a * F.pow(t["c"] / n, 3)
        return F.struct(t["x"].alias("x"), t["y"].alias("y"), t["z"].alias("z"), t["p"].alias("p"), (b * up).alias("s"), (a * out).alias("c"))

    def finish(t):
        u = F.atan2(t["s"] / b, t["c"] / a)
        height = t["p"] * F.cos(u) + t["z"] * F.sin(u) - a * F.sqrt(1 - e2 * F.sin(u) * F.sin(u))
        return F.struct(F.degrees(F.atan2(t["y"], t["x"])).alias("lon"), F.degrees(u).alias("lat"), height.alias("height"))

    done = F.aggregate(F.array(F.lit(1), F.lit(2)), start, step, finish)
    return done["lon"], done["lat"], done["height"]


def seven_parameters(x: Column, y: Column, z: Column, shift: tuple[float, float, float], turn: tuple[float, float, float] = (0.0, 0.0, 0.0), ppm: float = 0.0, frame: bool = False) -> tuple[Column, Column, Column]:
    """Geocentric similarity: shifts in metres, small turns in seconds of arc (of the position vector, or of the coordinate ``frame``), scale in parts per million."""
    sign = -1.0 if frame else 1.0
    rx, ry, rz = (sign * math.radians(t / 3600) for t in turn)
    m, (dx, dy, dz) = 1 + ppm * 1e-6, shift
    return m * (x - rz * y + ry * z) + dx, m * (rz * x + y - rx * z) + dy, m * (-ry * x + rx * y + z) + dz


def datum_shift(lon: Column, lat: Column, height: Column, source: str, target: str, shift, turn=(0.0, 0.0, 0.0), ppm: float = 0.0, frame: bool = False) -> tuple[Column, Column, Column]:
    """Longitude, latitude (degrees) and height on another ellipsoid and datum."""
    return geographic(*seven_parameters(*geocentric(lon, lat, height, source), shift, turn, ppm, frame), target)
