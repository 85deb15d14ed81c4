"""Delaunay triangulation in memory: the kernel that each tile of a triangulated surface runs."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1
_EPS = 4e-15


class Mesh:
    """Triangulation of distinct points by insertion: each point clears the triangles whose circle holds it and fans out over the hole.

    Signs are exact: rationals decide what rounding leaves open. Of points on one circle the first in order of (x, y) counts as raised
    by an amount that dwarfs those of all later ones, so the same points give the same triangles in any order and any company.
    Outside the hull stand ghost triangles with the vertex ``GHOST``.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float).tolist(), np.asarray(y, float).tolist()
        self.third: dict[tuple[int, int], int] = {}  # of each directed edge the third corner of its triangle
        n = len(self.x)
        if n < 3:
            return
        order = _snake(np.asarray(x, float), np.asarray(y, float)).tolist()
        a, b = order[0], order[1]
        k = next((k for k in range(2, n) if self.turn(a, b, order[k])), None)
        if k is None:
            return
        c = order[k]
        if self.turn(a, b, c) < 0:
            a, b = b, a
        for u, v, w in ((a, b, c), (b, a, GHOST), (c, b, GHOST), (a, c, GHOST)):
            self._add(u, v, w)
        self.last = (a, b)
        for p in order[2:k] + order[k + 1 :]:
            self._insert(p)

    def triangles(self) -> np.ndarray:
        """Corner numbers, counter-clockwise, one row a triangle."""
        return np.array([(u, v, w) for (u, v), w in self.third.items() if u >= 0 and w >= 0 and u < v and u < w and v >= 0], np.int64).reshape(-1, 3)

    def turn(self, a: int, b: int, c: int) -> int:
        """1 if the way from ``a`` over ``b`` to ``c`` turns left, -1 if right, 0 if straight."""
        x, y = self.x, self.y
        left, right = (x[a] - x[c]) * (y[b] - y[c]), (y[a] - y[c]) * (x[b] - x[c])
        d = left - right
        if abs(d) > _EPS * (abs(left) + abs(right)):
            return 1 if d > 0 else -1
        (ax, ay), (bx, by), (cx, cy) = ((Fraction(x[k]), Fraction(y[k])) for k in (a, b, c))
        d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        return (d > 0) - (d < 0)

    def holds(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether the circle of the triangle holds the point; that of a ghost is the half-plane beyond its edge, and the edge itself."""
        if GHOST in (a, b, c):
            if a == GHOST:
                a, b = b, c
            elif b == GHOST:
                a, b = c, a
            side = self.turn(a, b, p)
            if side:
                return side > 0
            x, y = self.x, self.y
            return min(x[a], x[b]) <= x[p] <= max(x[a], x[b]) and min(y[a], y[b]) <= y[p] <= max(y[a], y[b])
        x, y = self.x, self.y
        px, py = x[p], y[p]
        ax, ay, bx, by, cx, cy = x[a] - px, y[a] - py, x[b] - px, y[b] - py, x[c] - px, y[c] - py
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, ca, ab = bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx
        d = aa * bc + bb * ca + cc * ab
        size = aa * (abs(bx * cy) + abs(by * cx)) + bb * (abs(cx * ay) + abs(cy * ax)) + cc * (abs(ax * by) + abs(ay * bx))
        if abs(d) > 4 * _EPS * size:
            return d > 0
        return self._holds_exactly(a, b, c, p)

    def _holds_exactly(self, a: int, b: int, c: int, p: int) -> bool:
        (ax, ay), (bx, by), (cx, cy), (px, py) = ((Fraction(self.x[k]), Fraction(self.y[k])) for k in (a, b, c, p))
        ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
        d = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if d:
            return d > 0
        for k in sorted((a, b, c, p), key=lambda k: (self.x[k], self.y[k])):
            if k == p:
                return False
            side = self.turn(b, c, p) if k == a else self.turn(c, a, p) if k == b else self.turn(a, b, p)
            if side:
                return side > 0
        return False

    def _add(self, u: int, v: int, w: int) -> None:
        self.third[u, v], self.third[v, w], self.third[w, u] = w, u, v

    def _insert(self, p: int) -> None:
        u, v = self.last if self.last in self.third else next(iter(self.third))
        w = self.third[u, v]
        if GHOST in (u, v, w):  # start inside the hull
            while GHOST in (u, v):
                u, v, w = v, w, u
            u, v = v, u
            w = self.third[u, v]
        while w != GHOST:
            if self.turn(v, w, p) < 0:
                u, v = w, v
            elif self.turn(w, u, p) < 0:
                u, v = u, w
            elif self.turn(u, v, p) < 0:
                u, v = v, u
            else:
                break
            w = self.third[u, v]
        for e in ((u, v), (v, w), (w, u)):
            del self.third[e]
        todo = [(u, v), (v, w), (w, u)]
        while todo:
            a, b = todo.pop()
            c = self.third.get((b, a))
            if c is None:
                continue
            if self.holds(b, a, c, p):
                for e in ((b, a), (a, c), (c, b)):
                    del self.third[e]
                todo += [(a, c), (c, b)]
            else:
                self._add(a, b, p)
                if a != GHOST and b != GHOST:
                    self.last = (a, b)


def _snake(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order in which neighbours follow each other: strips, up and down in turn."""
    strips = max(1, int(len(x) ** 0.5 / 2))
    span = max(float(np.ptp(x)), 1e-300)
    strip = np.minimum(((x - x.min()) / span * strips).astype(np.int64), strips - 1)
    return np.lexsort((x, np.where(strip % 2, -y, y), strip))


def circles(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of the circle around each triangle."""
    ax, ay = x[t[:, 0]], y[t[:, 0]]
    bx, by, cx, cy = x[t[:, 1]] - ax, y[t[:, 1]] - ay, x[t[:, 2]] - ax, y[t[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return ax + ux, ay + uy, np.hypot(ux, uy)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the corners of the convex hull (of points in line only the ends)."""
    order = np.lexsort((y, x)).tolist()
    mesh = Mesh([], [])
    mesh.x, mesh.y = x.tolist(), y.tolist()
    if len(order) < 3:
        return np.array(order, np.int64)
    halves = []
    for way in (order, order[::-1]):
        out: list[int] = []
        for p in way:
            while len(out) > 1 and mesh.turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        halves += out[:-1]
    return np.array(sorted(set(halves)), np.int64)
