"""Scenes with a planted tilt, scale and heading."""

import numpy as np
import pytest

from strataspark.operators import levelling as L
from strataspark.operators.fits import _matrix


def _tables(spark, rng, turned, kind):
    centres = np.concatenate([rng.uniform(-20, 20, (40, 2)), rng.uniform(1, 3, (40, 1))], 1)
    photos = []
    for k, c in enumerate(centres):
        heading, tilt = (2 * np.pi * k / 40 if kind != "one way" else 0.1 * rng.normal()), 0.3 * rng.normal()
        if kind == "down":
            ahead = np.array([0.02 * rng.normal(), 0.02 * rng.normal(), -1.0])
            right = np.array([np.cos(heading), np.sin(heading), 0.0])
        else:
            ahead = np.array([np.cos(heading) * np.cos(tilt), np.sin(heading) * np.cos(tilt), np.sin(tilt)])
            right = np.array([np.sin(heading), -np.cos(heading), 0.0])
        ahead = ahead / np.linalg.norm(ahead)
        right = right - (right @ ahead) * ahead
        right /= np.linalg.norm(right)
        pose = np.array([right, np.cross(ahead, right), ahead]) @ turned.T
        photos.append((*map(float, turned @ c), *map(float, pose.ravel())))
    points = np.concatenate([rng.uniform(-30, 30, (300, 1)), rng.uniform(-10, 10, (300, 1)), rng.uniform(0, 5, (300, 1))], 1)
    return (
        centres, points,
        spark.createDataFrame(photos, "x double, y double, z double, " + ", ".join(f"{c} double" for c in L.ROWS)),
        spark.createDataFrame([tuple(map(float, turned @ p)) for p in points], "x double, y double, z double"),
    )


@pytest.mark.parametrize(("kind", "source", "most"), [("around", "level axes", 1e-6), ("down", "views", 0.02), ("one way", "upright axes", 0.1)])
def test_a_planted_tilt_is_taken_out(spark, kind, source, most):
    rng = np.random.default_rng(7)
    turned = _matrix(0.7, -0.4, 1.1)
    _, points, photos, cloud = _tables(spark, rng, turned, kind)
    t = L.level(photos.repartition(3), cloud)
    up = np.array(t["rotation"])[2]
    assert t["source"] == source and np.degrees(np.arccos(min(1.0, up @ turned[:, 2]))) < max(np.degrees(most), 1e-4)
    placed = np.array([r[:] for r in L.similarity_3d(cloud, t["scale"], t["rotation"], t["shift"]).select("x", "y", "z").collect()])
    assert np.allclose(np.array(t["rotation"]) @ np.array(t["rotation"]).T, np.eye(3)) and np.linalg.det(t["rotation"]) == pytest.approx(1)
    assert np.abs(np.median(placed[:, :2], axis=0)).max() < 1e-9 and np.quantile(placed[:, 2], 0.02) == pytest.approx(0, abs=1e-9)
    assert placed[:, 0].std() > 2 * placed[:, 1].std()


def test_gps_gives_scale_and_heading_but_no_tilt(spark):
    rng = np.random.default_rng(3)
    centres, points, photos, cloud = _tables(spark, rng, _matrix(0.2, 0.3, -0.5), "around")
    t = L.level(photos, cloud)
    rows = photos.select("x", "y", "z").collect()
    ground = [(2.5 * (np.cos(0.8) * c[0] - np.sin(0.8) * c[1]) + 500_000, 2.5 * (np.sin(0.8) * c[0] + np.cos(0.8) * c[1]) + 7_000_000, 2.5 * c[2] + 1200) for c in centres]
    noisy = [(*map(float, r), *(float(v + rng.normal(0, 0.3)) for v in g)) for r, g in zip(rows, ground, strict=True)] + [(0.0, 0.0, 0.0, None, None, None)]
    places = spark.createDataFrame(noisy, "x double, y double, z double, east double, north double, altitude double")
    found = L.scale_by_gps(t, places)
    assert found["scale"] == pytest.approx(2.5, rel=0.01) and found["residual"] < 1 and found["photos"] == 40
    assert np.allclose(np.array(found["rotation"])[2], np.array(t["rotation"])[2])
    placed = np.array([r[:] for r in L.similarity_3d(places.filter("east is not null"), found["scale"], found["rotation"], found["shift"]).select("x", "y", "z").collect()])
    assert np.abs(placed - np.array(ground)).max() < 1.5
    assert L.scale_by_gps(t, places.limit(3)) is None and L.scale_by_gps(t, places, least_spread=1e6) is None
    wild = places.selectExpr("x", "y", "z", "1000 * rand(1) as east", "1000 * rand(2) as north", "altitude")
    assert L.scale_by_gps(t, wild) is None


def test_no_photos(spark):
    rng = np.random.default_rng(3)
    _, _, photos, cloud = _tables(spark, rng, np.eye(3), "around")
    with pytest.raises(ValueError):
        L.level(photos.limit(0), cloud)
    assert L.level(photos, cloud.limit(0))["source"] == "level axes"
