"""Relative geometry of image pairs from given matches: seeded consensus of epipolar and plane models, all pairs side by side."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

MOST_DRAWS = 2_000
PART = 100_000  # matches that are worked on at once
SURE = 0.9999
KINDS = {"epipolar": 8, "plane": 4}
_MATCH = ["xa", "ya", "xb", "yb"]
_REPLY = "a string, b string, xa double, ya double, xb double, yb double, distance double, inlier boolean, model array<double>, matches long, inliers long"


def _normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points about their middle, on average at the root of two, and the matrix that brings them there."""
    middle = p.mean(0)
    size = np.hypot(*(p - middle).T).mean() or 1.0
    s = 2**0.5 / size
    return (p - middle) * s, np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])


def _null(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The vector of nine numbers that the rows of all parts make least. Long parts are folded into a triangle of nine rows one by one."""
    held = np.zeros((0, 9))
    for rows in parts:
        held = np.concatenate([held, rows])
        if len(held) > 9:
            held = np.linalg.qr(held, mode="r")
    return np.linalg.svd(held, full_matrices=True)[2][-1].reshape(3, 3)


def _parts(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(0, max(len(p), 1), PART):
        yield p[k : k + PART], q[k : k + PART]


def epipolar(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The matrix ``f`` of rank two with ``q' f p`` least over the matches."""
    (p, tp), (q, tq) = _normal(p), _normal(q)
    with_one = lambda v: np.column_stack([v, np.ones(len(v))])
    f = _null((with_one(w)[:, :, None] * with_one(v)[:, None, :]).reshape(-1, 9) for v, w in _parts(p, q))
    u, s, vt = np.linalg.svd(f)
    f = tq.T @ (u * [s[0], s[1], 0.0]) @ vt @ tp
    return f / (np.linalg.norm(f) or 1.0)


def plane(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The matrix ``h`` that takes ``p`` to ``q``."""
    (p, tp), (q, tq) = _normal(p), _normal(q)

    def rows(p, q):
        u, zero = np.column_stack([p, np.ones(len(p))]), np.zeros((len(p), 3))
        return np.concatenate([np.concatenate([u, zero, -q[:, :1] * u], 1), np.concatenate([zero, u, -q[:, 1:] * u], 1)])

    h = _null(rows(v, w) for v, w in _parts(p, q))
    h = np.linalg.inv(tq) @ h @ tp
    return h / (np.linalg.norm(h) or 1.0)


def distances(kind: str, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far matches lie from a model, in pixels: Sampson's distance, or the greater way between a point and its transfer, there and back."""
    return np.concatenate([_distances(kind, m, v, w) for v, w in _parts(p, q)])


def _distances(kind: str, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    u, v = np.column_stack([p, np.ones(len(p))]), np.column_stack([q, np.ones(len(q))])
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "epipolar":
            lp, lq = v @ m, u @ m.T
            d = np.abs((v * lq).sum(1)) / np.sqrt(lp[:, 0] ** 2 + lp[:, 1] ** 2 + lq[:, 0] ** 2 + lq[:, 1] ** 2)
        else:
            there = u @ m.T
            back = v @ np.linalg.pinv(m).T
            d = np.maximum(np.hypot(*(there[:, :2] / there[:, 2:] - q).T), np.hypot(*(back[:, :2] / back[:, 2:] - p).T))
    return np.where(np.isfinite(d), d, np.inf)


def consensus(kind: str, p: np.ndarray, q: np.ndarray, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The model that most matches agree with (of equals the one with less in sum), fitted again to them until they stay the same; with the distances."""
    need, fit = KINDS[kind], {"epipolar": epipolar, "plane": plane}[kind]
    if len(p) < need:
        return None
    rng, best, draws, k = np.random.default_rng(seed), None, MOST_DRAWS, 0
    while k < draws:
        k += 1
        some = rng.choice(len(p), need, replace=False)
        m = fit(p[some], q[some])
        d = distances(kind, m, p, q)
        inside = d <= tolerance
        key = (int(inside.sum()), -float(d[inside].sum()))
        if best is None or key > best[0]:
            best = (key, m, d)
            share = key[0] / len(p)
            if share > 0:
                draws = min(draws, int(np.ceil(np.log(1 - SURE) / np.log1p(-min(share**need, 1 - 1e-12)))) + 1)
    (count, _), m, d = best
    for _ in range(10):
        inside = d <= tolerance
        if inside.sum() < need:
            break
        again = fit(p[inside], q[inside])
        e = distances(kind, again, p, q)
        if (e <= tolerance).sum() < count or ((e <= tolerance) == inside).all() and e[inside].sum() >= d[inside].sum():
            break
        m, d, count = again, e, int((e <= tolerance).sum())
    return m, d


def relative_models(matches: DataFrame, kind: str = "epipolar", tolerance: float = 2.0, seed: int = 0) -> DataFrame:
    """Each match of ``a, b, xa, ya, xb, yb`` with its ``distance`` from the pair's model and whether it is an ``inlier``; ``model`` (nine numbers, by rows), ``matches`` and ``inliers`` of the pair.

    A pair's matches are a group (as many as two images share) and are put in order first, and draws follow from the names
    of the pair, so the result does not depend on how the table is dealt. Repeated matches count once for the draws' sake and
    are answered once. Pairs with fewer matches than the model needs (eight, or four for a ``plane``) have no model and no inlier.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    ship_package(matches.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        a, b = (table.column(c)[0].as_py() for c in "ab")
        xy = np.unique(np.stack([table.column(c).to_numpy() for c in _MATCH], 1), axis=0)
        xy = xy[np.isfinite(xy).all(1)]
        found = consensus(kind, xy[:, :2], xy[:, 2:], tolerance, zlib.crc32(f"{seed}|{a}|{b}".encode()))
        n = len(xy)
        d = np.full(n, np.nan) if found is None else found[1]
        inside = np.zeros(n, bool) if found is None else d <= tolerance
        cols = [pa.repeat(pa.scalar(a, pa.string()), n), pa.repeat(pa.scalar(b, pa.string()), n), *[pa.array(xy[:, k]) for k in range(4)], pa.array(d, pa.float64(), mask=np.isnan(d)), pa.array(inside)]
        models = pa.nulls(n, pa.list_(pa.float64())) if found is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 9), pa.array(np.tile(found[0].ravel(), n)))
        cols += [models, pa.array(np.full(n, n, np.int64)), pa.array(np.full(n, int(inside.sum()), np.int64))]
        return pa.table(cols, names=[c.split()[0] for c in _REPLY.split(", ")])

    rows = matches.selectExpr("cast(a as string) as a", "cast(b as string) as b", *[f"cast({c} as double) as {c}" for c in _MATCH])
    return rows.groupBy("a", "b").applyInArrow(run, _REPLY)
