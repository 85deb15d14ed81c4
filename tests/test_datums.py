"""Datum shifts against published sample points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import geometry as G
from strataspark.operators import cameras


def _row(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).head()


def test_published_places(spark):
    """Examples of the guidance note that defines these methods (geographic to geocentric; position vector from WGS 72 to WGS 84)."""
    lat, lon = 53 + 48 / 60 + 33.820 / 3600, 2 + 7 / 60 + 46.380 / 3600
    got = _row(spark, *G.geocentric(F.lit(lon), F.lit(lat), F.lit(73.0)))
    assert list(got) == pytest.approx([3771793.968, 140253.342, 5124304.349], abs=2e-3)
    got = _row(spark, *G.geographic(*[F.lit(v) for v in (3771793.968, 140253.342, 5124304.349)]))
    assert list(got) == pytest.approx([lon, lat, 73.0], abs=2e-3) and abs(got[0] - lon) < 1e-8 and abs(got[1] - lat) < 1e-8
    got = _row(spark, *G.seven_parameters(*[F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)], (0.0, 0.0, 4.5), (0.0, 0.0, 0.554), 0.219))
    assert list(got) == pytest.approx([3657660.78, 255778.43, 5201387.75], abs=6e-3)
    again = _row(spark, *G.seven_parameters(*[F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)], (0.0, 0.0, 4.5), (0.0, 0.0, -0.554), 0.219, frame=True))
    assert list(again) == pytest.approx(list(got), abs=1e-9)


@pytest.mark.parametrize("name", sorted(G.ELLIPSOIDS))
def test_there_and_back(spark, name):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(h)) for a, b, h in zip(rng.uniform(-180, 180, 40), rng.uniform(-89.9, 89.9, 40), rng.uniform(-1000, 400_000, 40), strict=True)] + [(10.0, 90.0, 5.0), (-170.0, -90.0, 5.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, h double")
    back = G.geographic(*G.geocentric(*[F.col(c) for c in ("lon", "lat", "h")], name), name)
    for r in df.select("lon", "lat", "h", *[c.alias(n) for c, n in zip(back, ("a", "b", "c"), strict=True)]).collect():
        assert abs(r["lat"] - r["b"]) < 1e-10 and abs(r["h"] - r["c"]) < 1e-6
        assert abs(r["lat"]) > 89.99 or abs(r["lon"] - r["a"]) < 1e-10


def test_shift_by_a_grid(spark):
    shifts = spark.createDataFrame([(r, c, 3.6 * c, 7.2 * r) for r in range(5) for c in range(6)], "row int, col int, dlon double, dlat double")
    points = spark.createDataFrame([(1, 12.0, 28.0), (2, 11.25, 27.5), (3, 50.0, 0.0)], "id long, lon double, lat double")
    got = {r["id"]: (r["lon"], r["lat"]) for r in cameras.grid_shift(points, shifts, 10.0, 30.0, 1.0, 1.0, "id").collect()}
    assert got[1] == pytest.approx((12.0 + 1.5 * 0.001, 28.0 + 1.5 * 0.002)) and got[2] == pytest.approx((11.25 + 0.75 * 0.001, 27.5 + 2.0 * 0.002))
    assert got[3] == (None, None)
