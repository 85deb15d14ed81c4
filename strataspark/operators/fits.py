"""Least-squares fits: sums of normal equations in Spark, small solves behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


def normal_sums(df: DataFrame, terms: list[Column], targets: list[Column], group: list[str] | None = None) -> DataFrame:
    """Sums of a linear fit by group: ``ata`` (rows of the upper triangle), ``atb`` by target, ``btb`` and ``n``."""
    ata = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    atb = [F.sum(t * b) for b in targets for t in terms]
    btb = [F.sum(b * b) for b in targets]
    return df.groupBy(*(group or [])).agg(F.array(*ata).alias("ata"), F.array(*atb).alias("atb"), F.array(*btb).alias("btb"), F.count(F.lit(1)).alias("n"))


def _solve(row, terms: int, targets: int):
    a = np.zeros((terms, terms))
    a[np.triu_indices(terms)] = row["ata"]
    a = a + np.triu(a, 1).T
    b = np.array(row["atb"]).reshape(targets, terms)
    x = np.linalg.lstsq(a, b.T, rcond=None)[0].T
    rest = np.maximum(np.array(row["btb"]) - (x * b).sum(1), 0)
    return x, rest


def fit(df: DataFrame, terms: list[Column], targets: list[Column]) -> tuple[np.ndarray, float, int]:
    """Coefficients (target by term), RMS of the rest and count of one fit; the sums are one row."""
    row = normal_sums(df, terms, targets).head()
    if not row["n"]:
        raise ValueError("nothing to fit")
    x, rest = _solve(row, len(terms), len(targets))
    return x, float(np.sqrt(rest.sum() / row["n"])), row["n"]


def precision(df: DataFrame, terms: list[Column], target: Column) -> dict:
    """Coefficients, ``sigma0``, their covariance and the redundancy of a fit, from one row of sums."""
    k = len(terms)
    row = normal_sums(df, terms, [target]).head()
    x, rest = _solve(row, k, 1)
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = row["ata"]
    inverse = np.linalg.pinv(a + np.triu(a, 1).T)
    free = row["n"] - k
    sigma0 = float(np.sqrt(rest[0] / free)) if free > 0 else float("nan")
    return {"x": x[0], "sigma0": sigma0, "inverse": inverse, "covariance": sigma0**2 * inverse, "redundancy": free}


def checked(df: DataFrame, terms: list[Column], target: Column) -> DataFrame:
    """Rows with ``residual``, ``redundancy`` (how far the others check it, 0..1) and ``w``, the standardised residual of data snooping.

    The inverse of the small normal matrix goes into the expression of each row, so the rows themselves do not move.
    An observation that nothing checks has no ``w``.
    """
    found = precision(df, terms, target)
    residual = target - sum((F.lit(float(c)) * t for c, t in zip(found["x"], terms, strict=True)), F.lit(0.0))
    share = sum((F.lit(float(q)) * terms[i] * terms[j] for i, row in enumerate(found["inverse"]) for j, q in enumerate(row)), F.lit(0.0))
    redundancy = F.greatest(F.lit(0.0), 1.0 - share)
    out = df.withColumns({"residual": residual, "redundancy": redundancy})
    return out.withColumn("w", F.when(F.col("redundancy") > 1e-9, F.col("residual") / (F.lit(max(found["sigma0"], 1e-9)) * F.sqrt("redundancy"))))


def affine_fit(marks: DataFrame) -> tuple[np.ndarray, float, int]:
    """Affine from ``col, row`` to ``x, y``: rows ``(a, b, c)`` of either coordinate. Needs three marks, for a residual four."""
    return fit(marks, [F.col("col"), F.col("row"), F.lit(1.0)], [F.col("x"), F.col("y")])


def similarity_2d(marks: DataFrame) -> dict:
    """Scale, turn and shift from ``col, row`` to ``x, y`` in closed form from sums."""
    c, r, x, y = (F.col(k) for k in ("col", "row", "x", "y"))
    s = marks.agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in {"c": c, "r": r, "x": x, "y": y, "cc": c * c + r * r, "p": c * x + r * y, "q": c * y - r * x}.items()]).head()
    n = s["n"]
    den = s["cc"] - (s["c"] ** 2 + s["r"] ** 2) / n
    a = (s["p"] - (s["c"] * s["x"] + s["r"] * s["y"]) / n) / den
    b = (s["q"] - (s["c"] * s["y"] - s["r"] * s["x"]) / n) / den
    return {"a": a, "b": b, "tx": (s["x"] - a * s["c"] + b * s["r"]) / n, "ty": (s["y"] - b * s["c"] - a * s["r"]) / n, "scale": float(np.hypot(a, b)), "angle": float(np.arctan2(b, a))}


def radial_fit(table: DataFrame, terms: int = 4) -> tuple[np.ndarray, float, int]:
    """Odd polynomial ``k0 r + k1 r^3 + ..`` of a table ``radius_mm, distortion_mm``; no more terms than rows."""
    r = F.col("radius_mm")
    scale = float(table.agg(F.max(F.abs(r))).head()[0] or 1.0)
    n = min(terms, table.count())
    x, rest, rows = fit(table, [F.pow(r / scale, F.lit(2.0 * k + 1)) for k in range(n)], [F.col("distortion_mm")])
    return x[0] / scale ** (2 * np.arange(n) + 1), rest, rows


def rpc_refinement(rows: DataFrame) -> np.ndarray:
    """Correction of a rational model from ``sample, line`` (predicted) to ``sample_seen, line_seen``: a shift, or an affine from four points on."""
    ds, dl = F.col("sample_seen") - F.col("sample"), F.col("line_seen") - F.col("line")
    if rows.count() < 4:
        s = rows.agg(F.avg(ds), F.avg(dl)).head()
        return np.array([[s[0], 0.0, 0.0], [s[1], 0.0, 0.0]])
    return fit(rows, [F.lit(1.0), F.col("sample"), F.col("line")], [ds, dl])[0]


def umeyama(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift from ``sx, sy, sz`` to ``tx, ty, tz``: sums in Spark, one small decomposition here."""
    s, t = [F.col(f"s{k}") for k in "xyz"], [F.col(f"t{k}") for k in "xyz"]
    row = pairs.agg(F.count(F.lit(1)), *[F.avg(v) for v in s + t], *[F.avg(a * b) for a in t for b in s], F.avg(sum((v * v for v in s), F.lit(0.0)))).head()
    ms, mt = np.array(row[1:4]), np.array(row[4:7])
    cov = np.array(row[7:16]).reshape(3, 3) - np.outer(mt, ms)
    u, d, vt = np.linalg.svd(cov)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    r = u @ flip @ vt
    scale = float(np.trace(np.diag(d) @ flip) / (row[16] - ms @ ms))
    return scale, r, mt - scale * r @ ms


def ray_points(rays: DataFrame) -> DataFrame:
    """Nearest point to the rays of each ``point_id`` (centre ``cx, cy, cz``, direction ``dx, dy, dz``): 3x3 sums and their closed-form solution."""
    d = [F.col(f"d{k}") for k in "xyz"]
    n2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    c = [F.col(f"c{k}") for k in "xyz"]
    m = {f"m{i}{j}": F.sum((1.0 if i == j else 0.0) - d[i] * d[j] / n2) for i in range(3) for j in range(i, 3)}
    b = {f"b{i}": F.sum(sum((((1.0 if i == j else 0.0) - d[i] * d[j] / n2) * c[j] for j in range(3)), F.lit(0.0))) for i in range(3)}
    s = rays.groupBy("point_id").agg(F.count(F.lit(1)).alias("rays"), *[v.alias(k) for k, v in (m | b).items()])
    a00, a01, a02, a11, a12, a22 = (F.col(k) for k in ("m00", "m01", "m02", "m11", "m12", "m22"))
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    det = a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02)
    det = F.when(F.abs(det) > 1e-12, det)
    x = (b0 * (a11 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a11 * b2)) / det
    y = (a00 * (b1 * a22 - a12 * b2) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / det
    z = (a00 * (a11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a11 * a02)) / det
    return s.select("point_id", "rays", x.alias("x"), y.alias("y"), z.alias("z"))


def _matrix(o: float, p: float, k: float) -> np.ndarray:
    so, co, sp, cp, sk, ck = np.sin(o), np.cos(o), np.sin(p), np.cos(p), np.sin(k), np.cos(k)
    return np.array([[cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck], [-cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk], [sp, -so * cp, co * cp]])


def _film(ground: np.ndarray, v: np.ndarray, focal: float) -> np.ndarray:
    c = (ground - v[:3]) @ _matrix(*v[3:]).T
    return -focal * c[:, :2] / c[:, 2:]


def _slopes(f, v: np.ndarray) -> np.ndarray:
    """Derivatives by central differences."""
    out = []
    for k in range(len(v)):
        h = 1e-6 * max(1.0, abs(v[k]))
        e = np.zeros(len(v))
        e[k] = h
        out.append((f(v + e) - f(v - e)) / (2 * h))
    return np.stack(out, 1)


def resect_one(film: np.ndarray, ground: np.ndarray, focal: float, rounds: int = 40):
    """Exterior orientation of one photo: Gauss-Newton from four headings, the best above the ground; with its covariance."""
    if len(film) < 3:
        return None
    spread_g = np.linalg.norm(ground[:, :2] - ground[:, :2].mean(0), axis=1).mean()
    spread_f = np.linalg.norm(film - film.mean(0), axis=1).mean()
    height = focal * spread_g / max(spread_f, 1e-9)
    best = None
    for kappa in (0.0, np.pi / 2, np.pi, -np.pi / 2):
        v = np.array([*ground[:, :2].mean(0), ground[:, 2].mean() + height, 0.0, 0.0, kappa])
        f = lambda u: (_film(ground, u, focal) - film).ravel()
        try:
            damp = 1e-3
            cost = float(f(v) @ f(v))
            for _ in range(rounds):
                r, j = f(v), _slopes(f, v)
                n = j.T @ j
                step = np.linalg.solve(n + damp * np.diag(np.diag(n)), -j.T @ r)
                new = float(f(v + step) @ f(v + step))
                if new < cost:
                    done = cost - new < 1e-16 * max(cost, 1e-30)
                    v, cost, damp = v + step, new, damp / 10
                    if done:
                        break
                else:
                    damp *= 10
                    if damp > 1e12:
                        break
        except np.linalg.LinAlgError:
            continue
        if v[2] > ground[:, 2].mean() and (best is None or cost < best[1]):
            best = (v, cost)
    if best is None:
        return None
    v, cost = best
    j = _slopes(lambda u: (_film(ground, u, focal) - film).ravel(), v)
    free = max(2 * len(film) - 6, 1)
    cov = np.linalg.pinv(j.T @ j) * cost / free
    angles = np.arctan2(np.sin(v[3:]), np.cos(v[3:]))
    return np.concatenate([v[:3], angles]), float(np.sqrt(cost / len(film))), cov


def resection(observations: DataFrame, focal: float) -> DataFrame:
    """Orientation of each photo from ``image_id, x_mm, y_mm, gx, gy, gz``: ``X0..kappa, rms_mm, sigmas, n``.

    A photo's measurements are few, so each is one group; photos with under three points have nulls.
    """
    ship_package(observations.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = resect_one(pdf[["x_mm", "y_mm"]].to_numpy(float), pdf[["gx", "gy", "gz"]].to_numpy(float), focal)
        values = [None] * 8 if found is None else [*found[0], found[1], np.sqrt(np.maximum(np.diag(found[2]), 0)).tolist()]
        return pd.DataFrame([[pdf["image_id"].iloc[0], *values, len(pdf)]], columns=["image_id", "X0", "Y0", "Z0", "omega", "phi", "kappa", "rms_mm", "sigmas", "n"])

    ddl = "image_id string, X0 double, Y0 double, Z0 double, omega double, phi double, kappa double, rms_mm double, sigmas array<double>, n long"
    return observations.groupBy("image_id").applyInPandas(one, ddl)


def block_adjustment(observations: DataFrame, exterior: dict, points: dict, control: dict, focal: float, rounds: int = 15, loss: str = "linear", scale: float = 0.01, control_sigma: float = 0.05):
    """``block.adjust`` for photos and points that the caller holds: the new exterior, the points table (``point_id, x, y, z``) and the RMS of each round."""
    from .block import EXTERIOR, adjust

    spark = observations.sparkSession
    photos = spark.createDataFrame([(k, *map(float, v)) for k, v in exterior.items()], "image_id string, " + ", ".join(f"{c} double" for c in EXTERIOR))
    start = spark.createDataFrame([(k, *map(float, v)) for k, v in points.items()], "point_id string, x double, y double, z double")
    fixed = spark.createDataFrame([(k, *map(float, v)) for k, v in control.items()], "point_id string, gx double, gy double, gz double")
    found = adjust(observations, photos, start, fixed, focal, rounds, loss, scale, control_sigma)
    return dict(zip(found.images, found.exterior, strict=True)), found.points, found.history
