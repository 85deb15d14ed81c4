"""Chained and thinned lines against a walk along the segments and the rule run in one piece."""

import random

import numpy as np
import pytest

from strataspark.operators import polylines as L
from strataspark.operators.grid import Grid
from strataspark.plans import terrain


def _segments(spark, lines):
    rows = []
    for k, (points, ring) in enumerate(lines):
        ids = [1000 * k + n for n in random.Random(k).sample(range(900), len(points))]
        pairs = list(zip(range(len(points)), range(1, len(points)), strict=False)) + ([(len(points) - 1, 0)] if ring else [])
        rows += [(ids[a], ids[b], *map(float, points[a]), *map(float, points[b])) for a, b in pairs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "u long, v long, x1 double, y1 double, x2 double, y2 double")


def test_lines_come_in_order(spark):
    rng = np.random.default_rng(1)
    lines = [(rng.random((n, 2)), ring) for n, ring in ((2, False), (3, True), (50, True), (333, False), (1, True), (700, True)) if n > 1]
    got = {}
    for r in L.chained(_segments(spark, lines)).collect():
        got.setdefault(r["line"] // 1000, []).append((r["seq"], r["x"], r["y"], r["closed"]))
    assert len(got) == len(lines)
    for k, (points, ring) in enumerate(lines):
        own = sorted(got[k])
        assert [s for s, *_ in own] == list(range(len(points) + ring)) and {c for *_, c in own} == {ring}
        found = [(x, y) for _, x, y, _ in own]
        want = [tuple(p) for p in points.tolist()]
        if ring:
            assert found[0] == found[-1]
            turn = want.index(found[0])
            want = want[turn:] + want[:turn] + [want[turn]]
        assert found == want


@pytest.mark.parametrize("section", [4000, 20])
def test_thinning_is_that_of_the_whole_line(spark, monkeypatch, section):
    monkeypatch.setattr(L, "SECTION", section)
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for line in range(4):
        n = 150 if line else 2
        x, y = np.cumsum(rng.normal(0, 1, n)), np.cumsum(rng.normal(0, 1, n))
        if line == 2:
            x[-1], y[-1] = x[0], y[0]
        if line == 3:
            y = 0 * x  # all on one chord
        rows += [(line, k, float(x[k]), float(y[k]), line == 2) for k in range(n)]
        want |= {(line, int(k)) for k in np.flatnonzero(L.kept_by_distance(x, y, 1.5))}
    got = L.simplified(spark.createDataFrame(rows, "line long, seq long, x double, y double, closed boolean"), 1.5)
    assert got.columns == ["line", "seq", "x", "y", "closed"]
    assert {(r["line"], r["seq"]) for r in got.collect()} == want


def test_kept_vertices_stay_within_the_tolerance():
    rng = np.random.default_rng(5)
    x, y = np.cumsum(rng.normal(0, 1, 400)), np.cumsum(rng.normal(0, 1, 400))
    keep = np.flatnonzero(L.kept_by_distance(x, y, 2.0))
    for a, b in zip(keep, keep[1:], strict=False):
        if b - a > 1:
            assert L._away(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b]).max() <= 2.0


def test_contours_of_a_cone_are_closed_rings_around_higher_ground(spark):
    n = 41
    rows, cols = np.mgrid[0:n, 0:n]
    cone = 10 * (1 - np.hypot(rows - 20.0, cols - 20.0) / 18)
    df = spark.createDataFrame([(int(r), int(c), float(cone[r, c])) for r in range(n) for c in range(n)], "row int, col int, value double")
    lines = terrain.contour_lines(df, 2.0, tolerance=0.2).filter("level between 2 and 8")
    rings = {}
    for r in lines.collect():
        assert r["closed"]
        rings.setdefault(r["level"], []).append((r["seq"], r["x"], r["y"]))
    assert sorted(rings) == [2.0, 4.0, 6.0, 8.0]
    for level, points in rings.items():
        p = np.array([q[1:] for q in sorted(points)])
        assert (p[0] == p[-1]).all() and 8 < len(p) < 60
        radius = np.hypot(*(p - 20).T)
        assert np.abs(radius - 18 * (1 - level / 10)).max() < 0.4
        east, north = p[:, 0], -p[:, 1]
        assert 0.5 * np.sum(east[:-1] * north[1:] - east[1:] * north[:-1]) > 0  # counter-clockwise: higher ground on the left
    feature = terrain.contour_features(lines, Grid(0.0, 41.0, 1.0, 1.0, n, n)).head()["feature"]
    assert '"type":"LineString"' in feature and '"elevation":' in feature


def test_names_of_edges_do_not_run_into_each_other(spark):
    far = spark.createDataFrame([(0, (1 << 22) + k, float(k)) for k in range(3)] + [(1, (1 << 22) + k, float(k)) for k in range(3)], "row int, col int, value double")
    with pytest.raises(Exception, match="names of their own"):
        terrain.contour_segments(far, 1.0).collect()
