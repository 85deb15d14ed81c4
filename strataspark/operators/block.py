"""Bundle adjustment of blocks of any number of points and many photos, with covariances from selected solves."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

DIRECT = 150  # photos up to which the reduced normals are small enough (6.5 MB) to be solved as one matrix on the driver
CHUNK_ROWS = 40_000  # observations that are linearised together
TOLERANCE = 1e-10
MOST_STEPS = 2_000
EXTERIOR = ["X0", "Y0", "Z0", "omega", "phi", "kappa"]


def rotations(angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ground-to-camera matrices of many angles (n x 3), and their derivatives by each angle (n x 3 x 3 x 3)."""
    (so, sp, sk), (co, cp, ck) = np.sin(angles.T), np.cos(angles.T)
    zero = np.zeros_like(so)
    pack = lambda rows: np.stack([np.stack(r, -1) for r in rows], -2)
    turn = pack([[cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck], [-cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk], [sp, -so * cp, co * cp]])
    by_omega = pack([[zero, co * sp * ck - so * sk, co * sk + so * sp * ck], [zero, -so * ck - co * sp * sk, co * ck - so * sp * sk], [zero, -co * cp, -so * cp]])
    by_phi = pack([[-sp * ck, so * cp * ck, -co * cp * ck], [sp * sk, -so * cp * sk, co * cp * sk], [cp, so * sp, -co * sp]])
    by_kappa = pack([[-cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk], [-cp * ck, -co * sk - so * sp * ck, co * sp * ck - so * sk], [zero, zero, zero]])
    return turn, np.stack([by_omega, by_phi, by_kappa], 1)


def linearised(ground: np.ndarray, exterior: np.ndarray, film: np.ndarray, focal: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (n x 2) of collinearity and their derivatives by exterior (n x 2 x 6) and ground (n x 2 x 3)."""
    turn, slopes = rotations(exterior[:, 3:])
    d = ground - exterior[:, :3]
    c = np.einsum("nij,nj->ni", turn, d)
    w = c[:, 2]
    r = -focal * c[:, :2] / w[:, None] - film
    by_c = np.zeros((len(d), 2, 3))
    by_c[:, 0, 0] = by_c[:, 1, 1] = -focal / w
    by_c[:, :, 2] = focal * c[:, :2] / (w * w)[:, None]
    b = by_c @ turn
    by_angles = np.einsum("nij,nkjl,nl->nik", by_c, slopes, d)
    return r, np.concatenate([-b, by_angles], 2), b


@dataclass
class Sums:
    """What a chunk of whole points gives: numbers of its distinct points and, by observation, the factors of the reduced normals."""

    image: np.ndarray
    point: np.ndarray
    r: np.ndarray
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray
    inverse: np.ndarray
    rank: np.ndarray
    g: np.ndarray
    cost: float


LEAST_SHARE = 1e-12  # of a point's greatest eigenvalue: what lies below is a direction that no ray fixes


def _inverse(v: np.ndarray, damp: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of the points' normals, and how many directions each point has fixed.

    Damped normals have an inverse. Without damping a point on a single ray (or on rays of one centre) has none along it: there the
    pseudo-inverse leaves the point where it is, so that its two equations say nothing about the photo.
    """
    if damp > 0:
        return np.linalg.inv(v), np.full(len(v), 3)
    values, vectors = np.linalg.eigh(v)
    fixed = values > LEAST_SHARE * values[:, -1:]
    parts = np.where(fixed, 1 / np.where(fixed, values, 1.0), 0.0)
    return (vectors * parts[:, None, :]) @ vectors.transpose(0, 2, 1), fixed.sum(1)


def _chunk(table: pa.Table, state: np.ndarray, focal: float, loss: str, scale: float, control_sigma: float, damp: float) -> Sums:
    col = lambda c: table.column(c).to_numpy()
    image = col("i").astype(np.int64)
    _, first, point = np.unique(np.array(table.column("point_id").to_pylist(), object), return_index=True, return_inverse=True)
    ground = np.stack([col(c) for c in "xyz"], 1)
    r, a, b = linearised(ground, state[image], np.stack([col("x_mm"), col("y_mm")], 1), focal)
    z = (r * r).sum(1) / scale**2
    weight = {"linear": np.ones_like(z), "soft_l1": 1 / np.sqrt(1 + z), "cauchy": 1 / (1 + z)}[loss]
    rho = {"linear": z, "soft_l1": 2 * (np.sqrt(1 + z) - 1), "cauchy": np.log1p(z)}[loss]
    v, g = np.zeros((len(first), 3, 3)), np.zeros((len(first), 3))
    np.add.at(v, point, weight[:, None, None] * (b.transpose(0, 2, 1) @ b))
    np.add.at(g, point, weight[:, None] * np.einsum("nij,ni->nj", b, r))
    known = np.stack([col(c)[first].astype(float) for c in ("gx", "gy", "gz")], 1)
    held = np.isfinite(known).all(1)
    k = (scale / control_sigma) ** 2
    off = np.where(held[:, None], ground[first] - known, 0.0)
    v[held] += k * np.eye(3)
    g += k * off
    diagonal = np.einsum("nii->ni", v)
    diagonal += damp * np.maximum(diagonal, 1e-12)
    inverse, rank = _inverse(v, damp)
    return Sums(image, point, r, a, b, weight, inverse, rank, g, float(rho.sum() + k * (off * off).sum() / scale**2))


def _couples(point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ordered couples of observations (also of one with itself) of one point."""
    order = np.argsort(point, kind="stable")
    size = np.bincount(point)
    start = np.cumsum(size) - size
    left = np.repeat(order, size[point[order]])
    own = point[left]
    place = np.arange(len(left)) - np.repeat(np.cumsum(size**2) - size**2, size**2)
    return left, order[start[own] + place % size[own]]


_NORMAL = "i int, j int, m array<double>, h array<double>, cost double, n long, fixed long, held long"


def _normals(sent, settings):
    def run(table: pa.Table) -> pa.Table:
        s = _chunk(table, sent.value, *settings)
        w = s.weight[:, None, None] * (s.a.transpose(0, 2, 1) @ s.b)
        left, right = _couples(s.point)
        m = -w[left] @ s.inverse[s.point[left]] @ w[right].transpose(0, 2, 1)
        here = left == right
        m[here] += s.weight[left[here], None, None] * (s.a[left[here]].transpose(0, 2, 1) @ s.a[left[here]])
        h = s.weight[:, None] * np.einsum("nij,ni->nj", s.a, s.r) - np.einsum("nij,njk,nk->ni", w, s.inverse[s.point], s.g[s.point])
        code, at = np.unique(s.image[left] << 32 | s.image[right], return_inverse=True)
        blocks, sides = np.zeros((len(code), 6, 6)), np.zeros((len(code), 6))
        np.add.at(blocks, at, m)
        i, j = code >> 32, code & 0xFFFFFFFF
        own = {int(k): n for n, k in enumerate(i) if i[n] == j[n]}
        np.add.at(sides, np.array([own[k] for k in s.image.tolist()], np.int64), h)
        first = np.zeros(len(code))
        first[0] = 1
        count = lambda v: pa.array((first * v).astype(np.int64))
        held = int(np.isfinite(table.column("gx").to_numpy()[np.unique(s.point, return_index=True)[1]]).sum())
        cols = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(list(blocks.reshape(-1, 36)), pa.list_(pa.float64())), pa.array(list(sides), pa.list_(pa.float64())), pa.array(first * s.cost)]
        return pa.table([*cols, count(len(s.image)), count(int(s.rank.sum())), count(held)], names=[c.split()[0] for c in _NORMAL.split(", ")])

    return run


def _moved(sent, settings):
    def run(table: pa.Table) -> pa.Table:
        state, delta = sent.value
        s = _chunk(table, state, *settings)
        back = s.g.copy()
        np.add.at(back, s.point, s.weight[:, None] * np.einsum("nij,nik,nk->nj", s.b, s.a, delta[s.image]))
        first = np.unique(s.point, return_index=True)[1]
        at = np.stack([table.column(c).to_numpy()[first] for c in "xyz"], 1) - np.einsum("nij,nj->ni", s.inverse, back)
        return pa.table([table.column("point_id").take(pa.array(first)), *[pa.array(at[:, k]) for k in range(3)]], names=["point_id", "x", "y", "z"])

    return run


def _loads(sent, settings, wanted):
    """Right-hand sides of asked points: their own inverse blocks and what ties each to its photos."""

    def run(table: pa.Table) -> pa.Table:
        s = _chunk(table, sent.value, *settings)
        ids = np.array(table.column("point_id").to_pylist(), object)
        rows = []
        for k in np.flatnonzero(np.isin(ids, list(wanted))):
            tie = s.inverse[s.point[k]] @ (s.weight[k] * s.b[k].T @ s.a[k])
            own = s.inverse[s.point[k]] if s.rank[s.point[k]] == 3 else np.full((3, 3), np.nan)
            rows.append((ids[k], int(s.image[k]), tie.ravel().tolist(), own.ravel().tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.list_(pa.float64())) for c in cols[2:]]], names=["point_id", "i", "tie", "own"])

    return run


class ReducedNormals:
    """The camera system: blocks ``i, j, m`` of 6 x 6 in a table, solved for several right-hand sides at once.

    Up to ``DIRECT`` photos the blocks fit into one small matrix; beyond, conjugate gradients multiply the table by
    vectors of six numbers a photo (the only thing that grows with the photos on the driver), with the inverse diagonal blocks before.
    """

    def __init__(self, blocks: DataFrame, photos: int):
        self.photos, self.small = photos, None
        self.blocks = blocks
        self.diagonal = np.zeros((photos, 6, 6))
        for r in blocks.filter("i = j").select("i", "m").toLocalIterator():
            self.diagonal[r["i"]] = np.array(r["m"]).reshape(6, 6)
        self.diagonal += 1e-12 * np.einsum("nii,ij->nij", np.maximum(np.abs(self.diagonal), 1e-12), np.eye(6))
        if photos <= DIRECT:
            self.small = np.zeros((6 * photos, 6 * photos))
            for r in blocks.select("i", "j", "m").collect():
                i, j = 6 * r["i"], 6 * r["j"]
                self.small[i : i + 6, j : j + 6] = np.array(r["m"]).reshape(6, 6)

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix by ``v`` (photos x 6 x columns): a pass over the table, one row of sums a photo and task."""
        sent, columns = self.blocks.sparkSession.sparkContext.broadcast(v), v.shape[2]

        def run(batches):
            held = sent.value
            for b in batches:
                i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
                m = b.column(2).flatten().to_numpy().reshape(-1, 6, 6)
                rows, at = np.unique(i, return_inverse=True)
                out = np.zeros((len(rows), 6, columns))
                np.add.at(out, at, m @ held[j])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(out.reshape(len(rows), -1)), pa.list_(pa.float64()))], names=["i", "v"])

        total = np.zeros_like(v)
        for r in self.blocks.select("i", "j", "m").mapInArrow(run, "i int, v array<double>").toLocalIterator():
            total[r["i"]] += np.array(r["v"]).reshape(6, columns)
        sent.unpersist()
        return total

    def solve(self, b: np.ndarray) -> np.ndarray:
        """``x`` (photos x 6 x columns) with the matrix by ``x`` equal to ``b``; of several solutions the least if the matrix is small."""
        if self.small is not None:
            scale = 1 / np.sqrt(np.maximum(np.diag(self.small), 1e-300))
            x = np.linalg.lstsq(self.small * scale[:, None] * scale, b.reshape(6 * self.photos, -1) * scale[:, None], rcond=1e-14)[0]
            return (x * scale[:, None]).reshape(b.shape)
        x, r = np.zeros_like(b), b.copy()
        before = np.linalg.inv(self.diagonal)
        z = before @ r
        p, rz = z.copy(), (r * z).sum((0, 1))
        goal = TOLERANCE**2 * np.maximum(rz, 1e-300)
        for _ in range(MOST_STEPS):
            on = rz > goal
            if not on.any():
                return x
            q = self.times(p)
            step = np.where(on, rz / np.where(on, (p * q).sum((0, 1)), 1), 0)
            x, r = x + step * p, r - step * q
            z = before @ r
            new = (r * z).sum((0, 1))
            p = z + np.where(on, new / np.where(on, rz, 1), 0) * p
            rz = np.where(on, new, rz)
        raise ArithmeticError("conjugate gradients did not settle: the datum of the block may not be fixed")


@dataclass
class Block:
    """A solved block: ``images`` in order with their ``exterior`` (n x 6), the table of ``points``, and the RMS (mm) of each round."""

    images: list[str]
    exterior: np.ndarray
    points: DataFrame
    history: list[float]
    sigma0: float
    redundancy: int
    normals: ReducedNormals
    rows: DataFrame
    settings: tuple
    place: dict[str, int] = field(default_factory=dict)

    def photo_covariances(self, images: list[str], together: int = 50) -> dict[str, np.ndarray]:
        """Covariance (6 x 6) of each asked photo, from solves for its six unit vectors; ``together`` photos share the passes."""
        out = {}
        for k in range(0, len(images), together):
            some = images[k : k + together]
            b = np.zeros((len(self.images), 6, 6 * len(some)))
            for n, i in enumerate(some):
                b[self.place[i], :, 6 * n : 6 * n + 6] = np.eye(6)
            x = self.normals.solve(b)
            for n, i in enumerate(some):
                c = x[self.place[i], :, 6 * n : 6 * n + 6]
                out[i] = self.sigma0**2 * (c + c.T) / 2
        return out

    def point_covariances(self, points: list[str]) -> dict[str, np.ndarray]:
        """Covariance (3 x 3) of each asked point: its own block, and what the photos that see it add. NaN for a point that its rays do not fix."""
        wanted = sorted(set(points))
        sent = self.rows.sparkSession.sparkContext.broadcast(self.exterior)
        asked = self.rows.drop("x", "y", "z").join(self.points, "point_id").filter(F.col("point_id").isin(wanted))
        found = asked.groupBy("chunk").applyInArrow(_loads(sent, self.settings, set(wanted)), "point_id string, i int, tie array<double>, own array<double>").collect()
        place = {p: n for n, p in enumerate(wanted)}
        b, own = np.zeros((len(self.images), 6, 3 * len(wanted))), {}
        for r in found:
            n = 3 * place[r["point_id"]]
            b[r["i"], :, n : n + 3] += np.array(r["tie"]).reshape(3, 6).T
            own[r["point_id"]] = np.array(r["own"]).reshape(3, 3)
        x = self.normals.solve(b)
        out = {}
        for p in own:
            n = 3 * place[p]
            out[p] = self.sigma0**2 * (own[p] + np.einsum("nij,nik->jk", b[:, :, n : n + 3], x[:, :, n : n + 3]))
        return out


def adjust(
    observations: DataFrame, exterior: DataFrame, points: DataFrame, control: DataFrame, focal: float, rounds: int = 15, loss: str = "linear", scale: float = 0.01, control_sigma: float = 0.05,
) -> Block:
    """Bundle adjustment by damped Gauss-Newton steps with the points eliminated.

    ``observations`` (``image_id, point_id, x_mm, y_mm``) meet ``points`` (``point_id, x, y, z``) and ``control`` (``point_id, gx, gy, gz``,
    known within ``control_sigma``); ``exterior`` has ``image_id`` and six numbers a photo. Chunks of whole points are linearised at once,
    eliminate their points and give blocks of the reduced normals for each two photos that share one; these are summed into
    a table. A step that does not lower the cost is taken back with more damping. Observations of unknown photos or
    points do not count; a point that a single photo sees moves along with it, says nothing about the photo and adds nothing to the redundancy.
    """
    spark = observations.sparkSession
    ship_package(spark)
    start = sorted(exterior.select("image_id", *EXTERIOR).collect(), key=lambda r: r["image_id"])  # six numbers a photo
    images = [r["image_id"] for r in start]
    place = {k: n for n, k in enumerate(images)}
    state = np.array([[float(r[c]) for c in EXTERIOR] for r in start]).reshape(-1, 6)
    numbers = spark.createDataFrame(list(place.items()), "image_id string, i int")
    known = control.select("point_id", *[F.col(c).cast("double").alias(c) for c in ("gx", "gy", "gz")])
    chunks = max(1, observations.count() // CHUNK_ROWS)
    rows = observations.join(numbers, "image_id").join(points.select("point_id"), "point_id", "left_semi").join(known, "point_id", "left")
    rows = rows.select("point_id", "i", F.col("x_mm").cast("double"), F.col("y_mm").cast("double"), "gx", "gy", "gz", F.pmod(F.xxhash64("point_id"), F.lit(chunks)).alias("chunk"))
    rows = materialise(rows, "block-rows")
    table = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])

    def linear(state, table, damp):
        settings = (focal, loss, scale, control_sigma, damp)
        chunked = rows.join(table, "point_id").groupBy("chunk")
        parts = materialise(chunked.applyInArrow(_normals(spark.sparkContext.broadcast(state), settings), _NORMAL), "block-parts")
        sums = parts.agg(F.sum("cost"), F.sum("n"), F.sum("fixed"), F.sum("held")).head()
        if not sums[1]:
            raise ValueError("no observation meets a photo and a point")
        return parts, sums, settings

    damp, history = 1e-6, []
    parts, sums, settings = linear(state, table, damp)
    for _ in range(rounds):
        history.append(scale * float(np.sqrt(sums[0] / sums[1])))
        normals, right = _summed(parts, len(images))
        delta = -normals.solve(right[:, :, None])[:, :, 0]
        sent = spark.sparkContext.broadcast((state, delta))
        moved = rows.join(table, "point_id").groupBy("chunk").applyInArrow(_moved(sent, settings), "point_id string, x double, y double, z double")
        moved = materialise(moved, "block-points")
        tried = linear(state + delta, moved, max(damp / 10, 1e-9))
        gain = sums[0] - tried[1][0]
        if gain >= 0:
            damp = max(damp / 10, 1e-9)
            state, table, (parts, sums, settings) = state + delta, moved, tried
        else:
            damp *= 100
            parts, sums, settings = linear(state, table, damp)
        if abs(gain) <= 1e-12 * sums[0] or damp > 1e8:
            break
    history.append(scale * float(np.sqrt(sums[0] / sums[1])))
    parts, sums, settings = linear(state, table, 0.0)
    redundancy = 2 * sums[1] + 3 * sums[3] - 6 * len(images) - sums[2]
    sigma0 = scale * float(np.sqrt(sums[0] / redundancy)) if redundancy > 0 else float("nan")
    normals, _ = _summed(parts, len(images))
    return Block(images, state, table, history, sigma0, redundancy, normals, rows, settings, place)


PRECISION = "image_id string, sigmas array<double>, corner_m double, corner_px double, pixel_m double"
WEAK_PIXELS = 5.0


def photo_precision(block: Block, half_width: float, half_height: float, ground: float, pixel_mm: float, together: int = 50) -> DataFrame:
    """``image_id, sigmas, corner_m, corner_px, pixel_m`` of each photo: its standard errors, and how far its worst frame corner may lie off on the ground."""
    from .diagnostics import corner_uncertainty

    focal, rows = block.settings[0], []
    for image, cov in block.photo_covariances(block.images, together).items():
        v = block.exterior[block.place[image]]
        corner = corner_uncertainty(v, cov, focal, half_width, half_height, ground)
        pixel = pixel_mm * (v[2] - ground) / focal
        rows.append((image, np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), float(corner), float(corner / pixel), float(pixel)))
    return block.rows.sparkSession.createDataFrame(rows, PRECISION)


def weak_photos(precision: DataFrame, control_sigma: float | None = None) -> DataFrame:
    """Photos whose corners are over ``WEAK_PIXELS`` pixels uncertain, and beyond what control of ``control_sigma`` explains (two and a half times it)."""
    return precision.filter((F.col("corner_px") > WEAK_PIXELS) & (F.col("corner_m") > 2.5 * (control_sigma or 0.0)))


def _summed(parts: DataFrame, photos: int) -> tuple[ReducedNormals, np.ndarray]:
    """The blocks of all chunks summed up, in order of their row, and the right-hand side."""
    sums = [F.sum(F.get("m", F.lit(k))) for k in range(36)]
    sides = [F.sum(F.get("h", F.lit(k))) for k in range(6)]
    total = parts.groupBy("i", "j").agg(F.array(*sums).alias("m"), F.array(*sides).alias("h"))
    table = materialise(total.repartitionByRange("i", "j").sortWithinPartitions("i", "j"), "block-normals")
    right = np.zeros((photos, 6))
    for r in table.filter("i = j").select("i", "h").toLocalIterator():  # six numbers a photo
        right[r["i"]] = r["h"]
    return ReducedNormals(table, photos), right
