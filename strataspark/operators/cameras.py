"""Cameras and coordinate systems: groups, pixel pitch, attitudes, presets, sanity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import project, transverse_mercator, transverse_mercator_inverse
from .quantiles import middle
from .ranks import global_rank

MERIDIANS = range(15, 35, 2)  # Lo zones


def presets() -> dict[str, dict]:
    """Coordinate systems by name: Lo zones in two datums (axes west and south, or east and north) and UTM zones 32 to 38."""
    out = {}
    for m in MERIDIANS:
        for datum, shape in (("Hart94", "WGS84"), ("WGS84", "WGS84"), ("Cape", "Clarke1880")):
            out[f"Lo{m} {datum}"] = {"central": m, "scale": 1.0, "east": 0.0, "north": 0.0, "ellipsoid": shape, "west_south": True}
        out[f"Lo{m} EN"] = {"central": m, "scale": 1.0, "east": 0.0, "north": 0.0, "ellipsoid": "WGS84", "west_south": False}
    for z in range(32, 39):
        for side, north in (("N", 0.0), ("S", 10_000_000.0)):
            out[f"UTM{z}{side}"] = {"central": 6 * z - 183, "scale": 0.9996, "east": 500_000.0, "north": north, "ellipsoid": "WGS84", "west_south": False}
    return out


def to_crs(lon: Column, lat: Column, name: str) -> tuple[Column, Column]:
    """Coordinates in a preset, or in EPSG 4326 and 3857."""
    if name in ("4326", "EPSG:4326"):
        return lon, lat
    if name in ("3857", "EPSG:3857"):
        r = 6_378_137.0
        return r * F.radians(lon), r * F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483))
    p = dict(presets()[name])
    flip = p.pop("west_south")
    x, y = transverse_mercator(lon, lat, **p)
    return (-x, -y) if flip else (x, y)


def from_crs(x: Column, y: Column, name: str) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in a preset, or in EPSG 4326 and 3857."""
    if name in ("4326", "EPSG:4326"):
        return x, y
    if name in ("3857", "EPSG:3857"):
        r = 6_378_137.0
        return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - 1.5707963267948966)
    p = dict(presets()[name])
    if p.pop("west_south"):
        x, y = -x, -y
    return transverse_mercator_inverse(x, y, **p)


def fitting_presets(points: DataFrame, half_width: float = 1.5) -> list[str]:
    """Presets in which the middle of the points (``lon, lat``) lies within half a zone and half a degree."""
    mid = {c: middle(points, c).head()["m"] for c in ("lon", "lat")}
    out = []
    for name, p in presets().items():
        wide = 3.0 if name.startswith("UTM") else half_width
        side = mid["lat"] < 0 if name.endswith("S") and name.startswith("UTM") else mid["lat"] >= 0 if name.startswith("UTM") else True
        if abs(mid["lon"] - p["central"]) <= wide + 0.5 and side:
            out.append((abs(mid["lon"] - p["central"]), name))
    return [n for _, n in sorted(out)]


def camera_groups(photos: DataFrame) -> DataFrame:
    """Photos with a dense camera number: equal make, model, rounded focal lengths and frame, in order of first use (``index``)."""
    key = F.concat_ws("|", F.coalesce("make", F.lit("")), F.coalesce("model", F.lit("")), F.round("focal", 2), F.round("focal35", 1), F.greatest("width", "height"), F.least("width", "height"))
    rows = photos.withColumn("__k", key)
    first = global_rank(rows.groupBy("__k").agg(F.min("index").alias("__first")), ["__first"], "camera")
    return rows.join(first.select("__k", "camera"), "__k").drop("__k")


def usual_camera(photos: DataFrame) -> DataFrame:
    """The largest camera group and how many photos are not of it."""
    n = photos.groupBy("camera").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by("camera", F.struct("n", -F.col("camera"))).alias("camera"), F.max("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))


def pixel_pitch(sensor_width: Column, width: Column, focal: Column, focal35: Column, plane_resolution: Column, unit: Column) -> Column:
    """Pixel size in mm: from the sensor, else the focal plane resolution (unit 2 inch, 3 cm), else the 35 mm equivalent."""
    per_mm = plane_resolution / F.when(unit == 2, 25.4).when(unit == 3, 10.0)
    return F.coalesce(sensor_width / width, 1 / F.when(per_mm > 0, per_mm), F.when(focal35 > 0, 36.0 * focal / focal35 / width))


def attitude_from_gimbal(yaw: Column, pitch: Column) -> list[Column]:
    """Omega, phi and kappa of a camera that heads ``yaw`` (clockwise from north) and looks ``pitch`` (down is -90), in degrees in and radians out."""
    a, p = F.radians(yaw), F.radians(pitch)
    # the image's right, its top and the axis out of its back, in east, north, up
    right = [F.cos(a), -F.sin(a), F.lit(0.0)]
    back = [-F.sin(a) * F.cos(p), -F.cos(a) * F.cos(p), -F.sin(p)]
    top = [back[1] * right[2] - back[2] * right[1], back[2] * right[0] - back[0] * right[2], back[0] * right[1] - back[1] * right[0]]
    phi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), back[0])))
    return [F.atan2(-back[1], back[2]), phi, F.atan2(-top[0], right[0])]


def footprint_corners(photos: DataFrame, half_width: float, half_height: float, focal: float, ground: float) -> DataFrame:
    """Ground places of the four frame corners of each photo: ``image_id, corner, x, y``; null where a ray does not fall."""
    from ..functions.geometry import rotation

    m = rotation(F.col("omega"), F.col("phi"), F.col("kappa"))
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(a * half_width).alias("u"), F.lit(b * half_height).alias("v")) for k, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    rays = photos.withColumn("c", F.explode(corners))
    d = [m[0][k] * F.col("c.u") + m[1][k] * F.col("c.v") - m[2][k] * focal for k in range(3)]
    s = (ground - F.col("Z0")) / F.when(d[2] < 0, d[2])
    return rays.select("image_id", F.col("c.corner").alias("corner"), (F.col("X0") + s * d[0]).alias("x"), (F.col("Y0") + s * d[1]).alias("y"))


def transfer(photos: DataFrame, points: DataFrame, focal: float, half_width: float, half_height: float) -> DataFrame:
    """Where points fall in photos: ``point_id, image_id, u, v`` inside the frame. Photos are few beside points and are broadcast below 10,000 of them."""
    p = photos.select("image_id", "X0", "Y0", "Z0", "omega", "phi", "kappa")
    small = F.broadcast(p) if p.limit(10_001).count() <= 10_000 else p
    # a photo sees what lies within its reach: both sides meet in cells of that size
    reach = photos.agg(F.max("Z0")).head()[0] * max(half_width, half_height) / focal * 3
    cell = lambda c: F.floor(c / F.lit(reach))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = points.withColumn("__s", F.explode(near)).withColumns({"__i": cell(F.col("x")) + F.col("__s.a"), "__j": cell(F.col("y")) + F.col("__s.b")})
    met = q.join(small.withColumns({"__i": cell(F.col("X0")), "__j": cell(F.col("Y0"))}), ["__i", "__j"])
    u, v = project([F.col(c) for c in "xyz"], [F.col("X0"), F.col("Y0"), F.col("Z0")], [F.col("omega"), F.col("phi"), F.col("kappa")], F.lit(focal))
    return met.filter(F.col("z") < F.col("Z0")).select("point_id", "image_id", u.alias("u"), v.alias("v")).filter((F.abs("u") <= half_width) & (F.abs("v") <= half_height))


def camera_sanity(cameras: DataFrame) -> DataFrame:
    """Rows ``camera, code, severity, message`` for cameras whose numbers cannot be."""
    from .imports import sanity

    rules = [
        ("focal_missing", "error", F.col("focal_mm").isNull() | (F.col("focal_mm") <= 0), "the focal length is not positive"),
        ("focal_units", "warning", F.col("focal_mm").between(1000, 400_000), "the focal length looks like micrometres or pixels"),
        ("pitch", "error", F.col("pitch_mm").isNotNull() & ((F.col("pitch_mm") <= 0) | (F.col("pitch_mm") > 0.1)), "the pixel size is out of range"),
        ("principal_point", "warning", F.hypot(F.coalesce("ppx_mm", F.lit(0.0)), F.coalesce("ppy_mm", F.lit(0.0))) > F.col("focal_mm") / 10, "the principal point lies far from the middle"),
    ]
    return sanity(cameras, rules).select("camera", "code", "severity", "message")


def grid_shift(points: DataFrame, shifts: DataFrame, west: float, north: float, step_lon: float, step_lat: float, key: str) -> DataFrame:
    """``key, lon, lat`` moved by a grid of shifts (``row, col, dlon, dlat`` in seconds of arc at cell centres), bilinear between centres; places beyond the grid are null."""
    from .stencils import bilinear

    at = points.select(key, F.col("lon").alias("x"), F.col("lat").alias("y"))
    out = points.select(key, "lon", "lat")
    for c in ("lon", "lat"):
        cells = shifts.select("row", "col", F.col(f"d{c}").alias("value"))
        moved = bilinear(cells, at, west, north, step_lon, step_lat, key).select(F.col(key).alias("moved"), F.col("value").alias(f"by_{c}"))
        out = out.join(moved, out[key] == moved["moved"], "left").drop("moved")
    return out.select(key, *[(F.col(c) + F.col(f"by_{c}") / 3600).alias(c) for c in ("lon", "lat")])
