"""A scene stood upright from its photos' directions, and set to scale from their GPS places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnostics import similarity_3d
from .quantiles import exact_quantiles

ROWS = [f"r{i}{j}" for i in range(3) for j in range(3)]


def level(photos: DataFrame, points: DataFrame) -> dict:
    """``rotation``, ``shift`` and where up came from (``source``), for a scene in any pose.

    ``photos`` have ``x, y, z`` and the world-to-camera turn ``r00 .. r22`` (image x to the right, y down, view ahead); ``points``
    have ``x, y, z``. A camera that is tilted keeps its x axis level, so with photos in many directions up is what is most
    nearly square to all x axes. Photos that all look down give up by their views, photos that face one way by their y axes
    without the part along their x axes, and photos that were held any way by the plane of their centres. Then the greatest
    spread of the points is turned to x, their medians to 0, and the second percentile of their heights to 0. All that comes
    to the driver are sums of three by three and a few quantiles.
    """
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    c = [F.col(k) for k in "xyz"]
    sums = [F.sum(r[0][i] * r[0][j]) for i in range(3) for j in range(3)] + [F.avg(v) for row in r for v in row] + [F.avg(v) for v in c] + [F.avg(c[i] * c[j]) for i in range(3) for j in range(3)]
    row = photos.agg(F.count(F.lit(1)), *sums).head()
    if not row[0]:
        raise ValueError("no photo to level by")
    n, square, means = row[0], np.array(row[1:10]).reshape(3, 3), np.array(row[10:19]).reshape(3, 3)
    centre, about = np.array(row[19:22]), np.array(row[22:31]).reshape(3, 3)
    right, down, ahead = means
    held, looked = np.linalg.norm(down), np.linalg.norm(ahead)
    values, axes = np.linalg.eigh(square)
    if looked > 0.7 and held < 0.5:
        up, source = -ahead, "views"
    elif held > 0.5 and values[1] > 0.05 * n:
        up, source = axes[:, 0] * np.sign(-axes[:, 0] @ down or 1.0), "level axes"
    elif held > 0.5:
        side = right / max(np.linalg.norm(right), 1e-12)
        up, source = -down + (down @ side) * side, "upright axes"
    else:
        normal = np.linalg.eigh(about - np.outer(centre, centre))[1][:, 0]
        up, source = normal * np.sign(-normal @ down or 1.0), "centres"
    z = up / np.linalg.norm(up)
    s = points.agg(F.count(F.lit(1)), *[F.avg(v) for v in c], *[F.avg(c[i] * c[j]) for i in range(3) for j in range(3)]).head()
    if s[0] >= 3:
        middle, spread = np.array(s[1:4]), np.array(s[4:13]).reshape(3, 3)
        spread = spread - np.outer(middle, middle)
    else:
        points, spread = photos.select("x", "y", "z"), about - np.outer(centre, centre)
    flat = np.eye(3) - np.outer(z, z)
    x = np.linalg.eigh(flat @ spread @ flat)[1][:, 2]
    x = flat @ x
    x /= np.linalg.norm(x)
    turn = np.array([x, np.cross(z, x), z])
    placed = similarity_3d(points.select("x", "y", "z"), 1.0, turn.tolist(), [0.0, 0.0, 0.0])
    shift = [-exact_quantiles(placed, k, [q]).head()["q"][0] for k, q in (("x", 0.5), ("y", 0.5), ("z", 0.02))]
    return {"scale": 1.0, "rotation": turn.tolist(), "shift": shift, "source": source, "units": "model"}


def scale_by_gps(transform: dict, places: DataFrame, least_spread: float = 10.0) -> dict | None:
    """The levelled scene on the map: scale, heading and shift from ``places`` (``x, y, z`` of the model with map ``east, north``, and ``altitude`` or null); the tilt stays.

    A plane similarity from sums over the photos. None if under four have a place, if they stand within ``least_spread`` (root mean
    square from their middle), or if the places fit by no better than half of that.
    """
    ok = places.filter("east is not null and north is not null")
    model = similarity_3d(ok, transform["scale"], transform["rotation"], transform["shift"])
    x, y, e, n = (F.col(k) for k in ("x", "y", "east", "north"))
    m = model.agg(F.count(F.lit(1)), F.avg(x), F.avg(y), F.avg(e), F.avg(n)).head()
    if m[0] < 4:
        return None
    a, b, u, v = x - m[1], y - m[2], e - m[3], n - m[4]  # set off first, as map numbers are large
    s = model.agg(F.sum(a * u + b * v), F.sum(a * v - b * u), F.sum(a * a + b * b), F.sum(u * u + v * v)).head()
    spread = float(np.sqrt(s[3] / m[0]))
    if spread < least_spread:
        return None
    factor = complex(s[0], s[1]) / max(s[2], 1e-12)
    left = float(np.sqrt(max(s[3] - abs(factor) ** 2 * s[2], 0.0) / m[0]))
    if left > 0.5 * spread:
        return None
    cos, sin = factor.real / abs(factor), factor.imag / abs(factor)
    heading = np.array([[cos, -sin, 0], [sin, cos, 0], [0, 0, 1]])
    turn, scale = heading @ np.array(transform["rotation"]), abs(factor) * transform["scale"]
    placed = similarity_3d(ok, scale, turn.tolist(), [0.0, 0.0, 0.0])
    mean = placed.agg(F.avg("x"), F.avg("y")).head()
    half = lambda c: exact_quantiles(placed, c, [0.5]).head()
    high = half("altitude")["q"] if "altitude" in places.columns else None
    up = (high[0] if high else 0.0) - half("z")["q"][0]
    return transform | {"scale": scale, "rotation": turn.tolist(), "shift": [m[3] - mean[0], m[4] - mean[1], up], "units": "m", "residual": left, "spread": spread, "photos": m[0]}
