"""Tiled triangulations against empty circles, one mesh of all points, and a plain ladder."""

from fractions import Fraction

import numpy as np
import pytest

from strataspark.operators import triangles as T
from strataspark.operators.delaunay import Mesh, hull
from strataspark.operators.grid import Grid


def _frame(spark, x, y, z):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, strict=True)], "x double, y double, z double")


def _key(r):
    return frozenset([(r["xa"], r["ya"], r["za"]), (r["xb"], r["yb"], r["zb"]), (r["xc"], r["yc"], r["zc"])])


def _whole(x, y, z):
    return [frozenset((x[k], y[k], z[k]) for k in t) for t in Mesh(x, y).triangles().tolist()]


def _clouds():
    rng = np.random.default_rng(4)
    gx, gy = np.meshgrid(np.arange(14.0), np.arange(11.0))
    apart = np.concatenate([rng.random((60, 2)) * 3, rng.random((50, 2)) * 2 + [40, 25]])
    ring = np.stack([20 + 15 * np.cos(np.arange(40) / 40 * 2 * np.pi), 20 + 15 * np.sin(np.arange(40) / 40 * 2 * np.pi)], 1)
    return {
        "random": rng.random((300, 2)) * 30,
        "lattice": np.stack([gx.ravel(), gy.ravel()], 1),
        "two clusters": apart,
        "ring around nothing": ring,
        "flat border": np.concatenate([np.stack([np.linspace(0, 30, 60), rng.random(60) * 1e-3], 1), rng.random((80, 2)) * [30, 10] + [0, 0.5]]),
    }


@pytest.mark.parametrize("name", list(_clouds()))
def test_tiles_give_the_one_mesh(spark, name):
    x, y = _clouds()[name].T
    z = np.round(np.sin(x) + y, 3)
    rows = T.delaunay(_frame(spark, x, y, z).repartition(3), side=4.0).collect()
    got = [_key(r) for r in rows]
    assert len(got) == len(set(got)) and set(got) == set(_whole(x, y, z))
    for r in rows:
        assert (r["xb"] - r["xa"]) * (r["yc"] - r["ya"]) > (r["yb"] - r["ya"]) * (r["xc"] - r["xa"])


def _in_circle(t, p):
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])) for q in t)
    return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)


@pytest.mark.parametrize("name", ["random", "lattice", "flat border"])
def test_every_circle_is_empty(spark, name):
    """By exact numbers over all points, those beyond tile edges included; and the triangles fill the hull."""
    p = _clouds()[name]
    rows = T.delaunay(_frame(spark, p[:, 0], p[:, 1], p[:, 0]), side=5.0).collect()
    area = 0.0
    for r in rows:
        t = [(r["xa"], r["ya"]), (r["xb"], r["yb"]), (r["xc"], r["yc"])]
        assert not any(_in_circle(t, q) > 0 for q in p)
        area += ((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])) / 2
    h = p[hull(p[:, 0], p[:, 1])]
    h = h[np.argsort(np.arctan2(*(h - h.mean(0)).T[::-1]))]
    assert area == pytest.approx(0.5 * abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))))


def test_layers_repeats_and_small_sets(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 0.0, 0.0, 5.0), (0, 9.0, 0.0, 2.0), (0, 0.0, 9.0, 3.0), (1, 1.0, 1.0, 0.0), (1, 2.0, 2.0, 0.0), (1, 3.0, 3.0, 0.0), (2, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0)], "layer int, x double, y double, z double")
    rows = T.delaunay(df, side=2.0).collect()
    assert [_key(r) for r in rows] == [frozenset([(0.0, 0.0, 5.0), (9.0, 0.0, 2.0), (0.0, 9.0, 3.0)])] and rows[0]["layer"] == 0
    assert T.delaunay(df.limit(0)).count() == 0
    assert T.tin_grid(df.limit(0), Grid.over(0, 0, 9, 9, 1.0)).count() == 0


def _plain_tin(x, y, z, g, max_edge=None):
    out = np.full((g.rows, g.cols), np.nan)
    for t in Mesh(x, y).triangles():
        p = np.stack([x[t], y[t]], 1)
        if max_edge is not None and max(np.hypot(*(p[i] - p[j])) for i, j in ((0, 1), (1, 2), (2, 0))) > max_edge:
            continue
        for r in range(g.rows):
            for c in range(g.cols):
                q = np.array([g.west + (c + 0.5) * g.cell_x, g.north - (r + 0.5) * g.cell_y])
                w = np.linalg.solve(np.vstack([p.T, np.ones(3)]), np.append(q, 1.0))
                if (w >= -1e-9).all():
                    out[r, c] = w @ z[t]
    return out


def _array(df, g):
    out = np.full((g.rows, g.cols), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.mark.parametrize("max_edge", [None, 4.0])
def test_surface_at_cell_centres(spark, max_edge):
    rng = np.random.default_rng(8)
    x, y = rng.random((2, 120)) * 20
    z = 2 * x - y + rng.random(120)
    g = Grid.over(0, 0, 20, 20, 1.0)
    got = _array(T.tin_grid(_frame(spark, x, y, z), g, max_edge, side=6.0), g)
    np.testing.assert_allclose(got, _plain_tin(x, y, z, g, max_edge), rtol=1e-9, atol=1e-9)


def test_pit_free_equals_a_plain_ladder_and_closes_pits(spark):
    rng = np.random.default_rng(9)
    x, y = rng.random((2, 700)) * 20
    crown = np.hypot(x - 10, y - 10) < 6
    z = np.where(crown, 12 - np.hypot(x - 10, y - 10), 0.1 * rng.random(700))
    slipped = crown & (rng.random(700) < 0.15)
    z[slipped] = 0.5 + 0.1 * rng.random(slipped.sum())  # returns that slipped into the crown
    g = Grid.over(0, 0, 20, 20, 1.0)
    got = _array(T.pit_free(_frame(spark, x, y, z), g, 2.5, side=7.0), g)
    top = {}
    for k in range(len(x)):
        key = (int((g.north - y[k]) * 2), int((x[k] - g.west) * 2))
        if key not in top or z[k] > z[top[key]]:
            top[key] = k
    top = np.array(list(top.values()))
    want = _plain_tin(x[top], y[top], z[top], g)
    for t in np.arange(2.5, z.max(), 2.5):
        up = top[z[top] >= t]
        want = np.fmax(want, _plain_tin(x[up], y[up], z[up], g, 3.0))
    held = np.zeros((g.rows, g.cols), bool)
    held[np.minimum((g.north - y).astype(int), g.rows - 1), x.astype(int)] = True
    near = np.zeros_like(held)
    for a in range(-2, 3):
        for b in range(-2, 3):
            if abs(a) + abs(b) <= 2:
                moved = np.zeros_like(held)
                moved[max(0, a) : held.shape[0] + min(0, a), max(0, b) : held.shape[1] + min(0, b)] = held[max(0, -a) : held.shape[0] + min(0, -a), max(0, -b) : held.shape[1] + min(0, -b)]
                near |= moved
    np.testing.assert_allclose(got, np.where(near, want, np.nan), rtol=1e-9, atol=1e-9)
    inner = got[8:12, 8:12]
    assert inner.min() > 6  # no pit is left in the crown


def test_tile_side_follows_the_fullest_tile(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random((900, 2)), rng.random((100, 2)) * 1000])
    own = T.distinct_points(_frame(spark, p[:, 0], p[:, 1], p[:, 0]))
    side = T.tile_side(own, 200)
    cells = np.unique(np.floor(p / side), axis=0, return_counts=True)[1]
    assert cells.max() <= 200
