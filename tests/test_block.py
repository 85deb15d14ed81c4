"""Block adjustment against a dense solve of all unknowns, by the small matrix and by conjugate gradients."""

import numpy as np
import pytest

from strataspark.operators import block as B
from strataspark.operators import fits


def _scene(seed=3, strips=2, photos=4, points=60, noise=0.003):
    rng = np.random.default_rng(seed)
    exterior = {f"p{s}{k}": np.array([180.0 * k, 250.0 * s, 1000.0, *rng.normal(0, 0.01, 2), rng.normal(0, 0.02)]) for s in range(strips) for k in range(photos)}
    ground = {f"t{k}": np.array([rng.uniform(-100, 180 * photos), rng.uniform(-150, 250 * strips), rng.uniform(0, 60)]) for k in range(points)}
    rows = []
    for i, e in exterior.items():
        for k, x in ground.items():
            u, v = fits._film(x[None], e, 150.0)[0]
            if abs(u) < 55 and abs(v) < 55:
                rows.append((i, k, float(u + rng.normal(0, noise)), float(v + rng.normal(0, noise))))
    seen = {p: sum(r[1] == p for r in rows) for p in ground}
    rows = [r for r in rows if seen[r[1]] > 1]
    ground = {p: x for p, x in ground.items() if seen[p] > 1}
    control = {k: ground[k] for k in list(ground)[:8]}
    return rng, exterior, ground, control, rows


def _tables(spark, rng, exterior, ground, control, rows):
    start = [(i, *map(float, e + rng.normal(0, 1, 6) * [2, 2, 2, 0.003, 0.003, 0.003])) for i, e in exterior.items()]
    first = [(k, *map(float, x if k in control else x + rng.normal(0, 2, 3))) for k, x in ground.items()]
    return (
        spark.createDataFrame(rows, "image_id string, point_id string, x_mm double, y_mm double"),
        spark.createDataFrame(start, "image_id string, X0 double, Y0 double, Z0 double, omega double, phi double, kappa double"),
        spark.createDataFrame(first, "point_id string, x double, y double, z double"),
        spark.createDataFrame([(k, *map(float, x)) for k, x in control.items()], "point_id string, gx double, gy double, gz double"),
    )


def _dense(found, points, control, rows, scale, sigma):
    """Normals of all unknowns at the solution, with slopes by central differences."""
    images, names = {k: n for n, k in enumerate(found.images)}, {k: n for n, k in enumerate(sorted(points))}
    base = 6 * len(images)
    j, r = np.zeros((2 * len(rows) + 3 * len(control), base + 3 * len(names))), np.zeros(2 * len(rows) + 3 * len(control))
    for n, (i, p, u, v) in enumerate(rows):
        e, x = found.exterior[images[i]], points[p]
        j[2 * n : 2 * n + 2, 6 * images[i] : 6 * images[i] + 6] = fits._slopes(lambda q: fits._film(x[None], q, 150.0).ravel(), e)  # noqa: B023
        j[2 * n : 2 * n + 2, base + 3 * names[p] : base + 3 * names[p] + 3] = fits._slopes(lambda q: fits._film(q[None], e, 150.0).ravel(), x)  # noqa: B023
        r[2 * n : 2 * n + 2] = fits._film(x[None], e, 150.0)[0] - [u, v]
    for n, (p, x) in enumerate(control.items()):
        at = 2 * len(rows) + 3 * n
        j[at : at + 3, base + 3 * names[p] : base + 3 * names[p] + 3] = scale / sigma * np.eye(3)
        r[at : at + 3] = scale / sigma * (points[p] - x)
    return j, r, base, names


@pytest.mark.parametrize("direct", [150, 0], ids=["matrix", "conjugate gradients"])
def test_solution_and_covariances_equal_the_dense_ones(spark, monkeypatch, direct):
    monkeypatch.setattr(B, "DIRECT", direct)
    monkeypatch.setattr(B, "CHUNK_ROWS", 60)
    rng, exterior, ground, control, rows = _scene()
    found = B.adjust(*_tables(spark, rng, exterior, ground, control, rows), 150.0, rounds=8, control_sigma=0.02)
    points = {r["point_id"]: np.array([r["x"], r["y"], r["z"]]) for r in found.points.collect()}
    j, r, base, names = _dense(found, points, control, rows, 0.01, 0.02)
    slope = j.T @ r / (np.linalg.norm(j, axis=0) * np.linalg.norm(r))
    assert np.abs(slope).max() < 1e-5  # no direction lowers the cost any more
    assert found.redundancy == len(r) - j.shape[1]
    sigma0 = np.sqrt(r @ r / found.redundancy)
    assert found.sigma0 == pytest.approx(sigma0, rel=1e-6) and 0.002 < found.sigma0 < 0.004
    cov = sigma0**2 * np.linalg.inv(j.T @ j)
    photos = found.photo_covariances(found.images, together=3)
    for n, i in enumerate(found.images):
        want = cov[6 * n : 6 * n + 6, 6 * n : 6 * n + 6]
        np.testing.assert_allclose(photos[i], want, rtol=2e-4, atol=2e-4 * np.sqrt(np.outer(np.diag(want), np.diag(want))).max())
        off = np.abs(found.exterior[n] - exterior[i]) / np.sqrt(np.diag(want))
        assert off.max() < 5
    asked = [p for p in names if p not in control][:3] + list(control)[:1]
    for p, got in found.point_covariances(asked).items():
        at = base + 3 * names[p]
        np.testing.assert_allclose(got, cov[at : at + 3, at : at + 3], rtol=2e-4, atol=1e-6)


def test_derivatives():
    rng = np.random.default_rng(1)
    ground, exterior = rng.uniform(-50, 50, (20, 3)), np.concatenate([rng.uniform(-20, 20, (20, 2)), rng.uniform(500, 600, (20, 1)), rng.uniform(-0.6, 0.6, (20, 3))], 1)
    r, a, b = B.linearised(ground, exterior, np.zeros((20, 2)), 150.0)
    for k in range(20):
        np.testing.assert_allclose(r[k], fits._film(ground[k][None], exterior[k], 150.0)[0], rtol=1e-12)
        np.testing.assert_allclose(a[k], fits._slopes(lambda q: fits._film(ground[k][None], q, 150.0).ravel(), exterior[k]), rtol=1e-5, atol=1e-5)  # noqa: B023
        np.testing.assert_allclose(b[k], fits._slopes(lambda q: fits._film(q[None], exterior[k], 150.0).ravel(), ground[k]), rtol=1e-5, atol=1e-6)  # noqa: B023


def test_a_robust_loss_finds_the_blunder(spark):
    rng, exterior, ground, control, rows = _scene(5)
    rows[10] = (rows[10][0], rows[10][1], rows[10][2] + 2.0, rows[10][3])
    found = B.adjust(*_tables(spark, rng, exterior, ground, control, rows), 150.0, rounds=10, loss="cauchy", control_sigma=0.02)
    off = [np.linalg.norm(found.exterior[n][:3] - exterior[i][:3]) for n, i in enumerate(found.images)]
    assert max(off) < 1.0


def test_large_sparse_block_without_a_matrix(spark):
    """Conjugate gradients on a chain of 3,000 photos: the driver holds vectors only."""
    rng = np.random.default_rng(2)
    n = 3000
    rows = [(k, k, (np.eye(6) * 4).ravel().tolist()) for k in range(n)]
    link = rng.normal(0, 0.3, (n - 1, 6, 6))
    rows += [(k, k + 1, link[k].ravel().tolist()) for k in range(n - 1)] + [(k + 1, k, link[k].T.ravel().tolist()) for k in range(n - 1)]
    normals = B.ReducedNormals(spark.createDataFrame(rows, "i int, j int, m array<double>"), n)
    assert normals.small is None
    want = rng.normal(0, 1, (n, 6, 2))
    right = 4 * want
    right[:-1] += link @ want[1:]
    right[1:] += link.transpose(0, 2, 1) @ want[:-1]
    np.testing.assert_allclose(normals.times(want), right, rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(normals.solve(right), want, rtol=1e-6, atol=1e-6)


def test_nothing_to_adjust(spark):
    rng, exterior, ground, control, rows = _scene()
    obs, photos, first, fixed = _tables(spark, rng, exterior, ground, control, rows)
    with pytest.raises(ValueError):
        B.adjust(obs.limit(0), photos, first, fixed, 150.0)


def test_precision_of_photos(spark):
    rng, exterior, ground, control, rows = _scene()
    found = B.adjust(*_tables(spark, rng, exterior, ground, control, rows), 150.0, rounds=6, control_sigma=0.02)
    p = {r["image_id"]: r for r in B.photo_precision(found, 55.0, 55.0, 30.0, 0.01).collect()}
    assert p.keys() == exterior.keys()
    photo = found.images[0]
    cov, at = found.photo_covariances([photo])[photo], found.exterior[0]
    worst = 0.0
    for u in (-55.0, 55.0):
        for v in (-55.0, 55.0):
            def place(q):
                d = fits._matrix(*q[3:]).T @ np.array([u, v, -150.0])  # noqa: B023
                return q[:2] + (30.0 - q[2]) / d[2] * d[:2]

            j = fits._slopes(place, at)
            worst = max(worst, float(np.sqrt(np.trace(j @ cov @ j.T))))
    assert p[photo]["corner_m"] == pytest.approx(worst, rel=1e-3)
    assert p[photo]["corner_px"] == pytest.approx(worst / (0.01 * (at[2] - 30) / 150), rel=1e-3)
    table = B.photo_precision(found, 55.0, 55.0, 30.0, 0.01)
    assert B.weak_photos(table, 1e9).count() == 0 and B.weak_photos(table).count() == sum(r["corner_px"] > 5 for r in p.values())


def test_a_point_on_one_ray_changes_nothing(spark):
    """Its normals are singular without damping; it says nothing about its photo, and its own place has no covariance."""
    rng, exterior, ground, control, rows = _scene()
    tables = _tables(spark, rng, exterior, ground, control, rows)
    lone = fits._film(np.array([[10.0, 20.0, 30.0]]), exterior["p00"], 150.0)[0]
    seen = tables[0].union(spark.createDataFrame([("p00", "lone", float(lone[0]), float(lone[1]))], tables[0].schema))
    place = tables[2].union(spark.createDataFrame([("lone", 11.0, 19.0, 32.0)], tables[2].schema))
    without = B.adjust(*tables, 150.0, rounds=6, control_sigma=0.02)
    found = B.adjust(seen, tables[1], place, tables[3], 150.0, rounds=6, control_sigma=0.02)
    assert found.redundancy == without.redundancy
    assert found.sigma0 == pytest.approx(without.sigma0, rel=1e-6)
    np.testing.assert_allclose(found.exterior, without.exterior, rtol=1e-6, atol=1e-6)
    one, two = (b.photo_covariances(["p00"])["p00"] for b in (found, without))
    np.testing.assert_allclose(one, two, rtol=1e-4, atol=1e-10)
    assert np.isnan(found.point_covariances(["lone"])["lone"]).all()
