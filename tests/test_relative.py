"""Consensus of pairs with planted outliers."""

import numpy as np
import pytest

from strataspark.operators import relative as R
from strataspark.operators.fits import _matrix


def _pair(rng, flat, n=80, wrong=30):
    ground = np.concatenate([rng.uniform(-40, 40, (n, 2)), (np.zeros((n, 1)) if flat else rng.uniform(0, 25, (n, 1)))], 1)
    out = []
    for place, angles in ((np.array([-8.0, 0, 90]), (0.02, -0.03, 0.1)), (np.array([9.0, 3, 95]), (-0.05, 0.04, -0.3))):
        c = (ground - place) @ _matrix(*angles).T
        out.append(500 - 900 * c[:, :2] / c[:, 2:] + rng.normal(0, 0.2, (n, 2)))
    bad = rng.choice(n, wrong, replace=False)
    out[1][bad] += rng.uniform(60, 300, (wrong, 2)) * rng.choice([-1, 1], (wrong, 2))
    true = np.ones(n, bool)
    true[bad] = False
    return out[0], out[1], true


@pytest.mark.parametrize("kind", ["epipolar", "plane"])
def test_planted_outliers_are_told_apart(spark, kind):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for k in range(4):
        p, q, true = _pair(rng, kind == "plane")
        for a, b, t in zip(p, q, true, strict=True):
            rows.append((f"i{k}", f"j{k}", *map(float, a), *map(float, b)))
            truth[rows[-1]] = bool(t)
    rows += [("few", "x", 1.0, 2.0, 3.0, 4.0), rows[0], ("nan", "x", float("nan"), 1.0, 1.0, 1.0)]
    ddl = "a string, b string, xa double, ya double, xb double, yb double"
    got = [
        {(r["a"], r["b"], r["xa"], r["ya"], r["xb"], r["yb"]): r for r in R.relative_models(spark.createDataFrame(some, ddl).repartition(n), kind, 1.5).collect()}
        for some, n in ((rows, 1), (rows[::-1], 5))
    ]
    assert got[0] == got[1]  # whatever the partitions and the order
    few = got[0].pop(("few", "x", 1.0, 2.0, 3.0, 4.0))
    assert few["model"] is None and not few["inlier"] and few["distance"] is None and got[0].keys() == truth.keys()
    wrong = [k for k, t in truth.items() if got[0][k]["inlier"] != t]
    # a wrong match may lie on its epipolar line by chance
    assert not [k for k in wrong if truth[k]] and len(wrong) <= (0 if kind == "plane" else 3)
    for r in got[0].values():
        own = [x for x in got[0].values() if x["a"] == r["a"]]
        assert r["inliers"] == sum(x["inlier"] for x in own) and r["matches"] == len(own)
        d = R.distances(kind, np.array(r["model"]).reshape(3, 3), np.array([[r["xa"], r["ya"]]]), np.array([[r["xb"], r["yb"]]]))[0]
        assert d == pytest.approx(r["distance"]) and r["inlier"] == (d <= 1.5)


def test_models_of_clean_matches():
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.02, 5.0], [-0.03, 0.95, -7.0], [1e-4, -2e-4, 1.0]])
    p = rng.uniform(0, 500, (20, 2))
    q = np.column_stack([p, np.ones(20)]) @ h.T
    q = q[:, :2] / q[:, 2:]
    found = R.plane(p, q)
    np.testing.assert_allclose(found / found[2, 2], h, rtol=1e-8, atol=1e-8)
    f = R.epipolar(*_pair(rng, False, 60, 0)[:2])
    assert abs(np.linalg.det(f)) < 1e-12 and np.linalg.norm(f) == pytest.approx(1)


def test_empty_tables_and_kinds(spark):
    df = spark.createDataFrame([], "a string, b string, xa double, ya double, xb double, yb double")
    assert R.relative_models(df).count() == 0
    with pytest.raises(ValueError):
        R.relative_models(df, "sphere")


def test_many_matches_take_memory_in_proportion():
    """A fit to 200,000 matches holds no matrix as wide as it is long, and a first draw that few agree with asks for finitely many more."""
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 1000, (200_000, 2))
    w = 1 + 1e-4 * p[:, 0] - 2e-4 * p[:, 1]
    q = np.stack([(1.1 * p[:, 0] + 0.02 * p[:, 1] + 5) / w, (0.95 * p[:, 1] - 0.03 * p[:, 0] - 7) / w], 1)
    wrong = np.arange(len(p)) % 5 == 0
    q[wrong] += rng.uniform(60, 160, (wrong.sum(), 2))
    _, d = R.consensus("plane", p, q, 0.5, 3)
    np.testing.assert_array_equal(d <= 0.5, ~wrong)
    assert R.distances("plane", R.plane(p[~wrong], q[~wrong]), p[~wrong], q[~wrong]).max() < 1e-6
    for share in (4e-6, 1.0):
        assert np.isfinite(np.ceil(np.log(1 - R.SURE) / np.log1p(-min(share**8, 1 - 1e-12))))
