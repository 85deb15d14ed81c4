"""Seams against Dijkstra's rule over whole layers; meshes against what closed surfaces must have."""

import heapq
from collections import Counter

import numpy as np
import pytest

from strataspark.operators import meshes, seams


def _layers():
    rng = np.random.default_rng(6)
    out = {}
    for k, (r0, r1, c0, c1) in enumerate([(0, 14, 0, 13), (3, 17, 7, 22), (0, 10, 15, 25), (5, 9, 8, 12)]):
        a = np.full((18, 26), np.nan)
        a[r0:r1, c0:c1] = 100 + 20 * rng.random((r1 - r0, c1 - c0))
        a[8, 9] = np.nan
        out[k] = a
    return out


def _frame(spark, layers):
    return spark.createDataFrame([(k, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for k, a in layers.items() for r in range(a.shape[0]) for c in range(a.shape[1])], "layer int, row int, col int, value double")


def _plain(layers):
    stack = np.stack([layers[k] for k in sorted(layers)])
    count = np.isfinite(stack).sum(0)
    spread = np.zeros(count.shape)
    for at in zip(*np.nonzero(count > 1), strict=True):
        v = stack[(slice(None), *at)]
        v = v[np.isfinite(v)]
        spread[at] = np.abs(v - np.median(v)).mean()
    cost = 1 + 8 * spread / max(np.median(spread[count > 1]), 1e-6)
    ways = np.full(stack.shape, np.inf)
    for k, a in enumerate(stack):
        mask = np.isfinite(a)
        depth = np.zeros(mask.shape)
        for r, c in zip(*np.nonzero(mask), strict=True):
            reach = []
            for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                n = 0
                while 0 <= r + (n + 1) * dr < mask.shape[0] and 0 <= c + (n + 1) * dc < mask.shape[1] and mask[r + (n + 1) * dr, c + (n + 1) * dc]:
                    n += 1
                reach.append(n)
            depth[r, c] = min(reach) + 1
        core = mask & ((count == 1) | (depth >= 0.8 * depth.max()))
        heap = [(0.0, int(r), int(c)) for r, c in zip(*np.nonzero(core), strict=True)]
        ways[k][core] = 0
        while heap:
            d, r, c = heapq.heappop(heap)
            if d > ways[k, r, c]:
                continue
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and d + 0.5 * (cost[r, c] + cost[q]) < ways[(k, *q)]:
                    ways[(k, *q)] = d + 0.5 * (cost[r, c] + cost[q])
                    heapq.heappush(heap, (float(ways[(k, *q)]), *q))
    return ways


@pytest.mark.parametrize("tile", [5, 64])
def test_ways_and_owners_equal_those_of_whole_layers(spark, tile):
    layers = _layers()
    ways = _plain(layers)
    df = _frame(spark, layers).repartition(3)
    got = {(r["layer"], r["row"], r["col"]): r["dist"] for r in seams.distances(seams.cores(df, seams.disagreement(df)), tile).collect()}
    want = {tuple(map(int, at)): ways[at] for at in zip(*np.nonzero(np.isfinite(np.stack(list(layers.values())))), strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    owner = {(r["row"], r["col"]): r["layer"] for r in seams.least_difference(df, tile).collect()}
    for (r, c), layer in owner.items():
        assert ways[layer, r, c] == pytest.approx(ways[:, r, c].min(), rel=1e-9)
    mosaic = {(r["row"], r["col"]): r["value"] for r in seams.seam_mosaic(df, tile).collect()}
    assert mosaic == {at: layers[k][at] for at, k in owner.items()}


def test_a_way_around_a_wall_crosses_tiles_back_and_forth(spark):
    n = 12
    a = np.full((n, n), np.nan)
    a[:, :] = 1.0
    for k in range(1, n, 4):
        a[k, : n - 1] = np.nan
    for k in range(3, n, 4):
        a[k, 1:] = np.nan
    rows = [(0, r, c, 1.0, r == n - 1 and c == 0) for r in range(n) for c in range(n) if np.isfinite(a[r, c])]
    nodes = spark.createDataFrame(rows, "layer long, row int, col int, cost double, core boolean")
    got = {(r["row"], r["col"]): r["dist"] for r in seams.distances(nodes, 4).collect()}
    longest = {(n - 1, 0): 0.0}
    todo = [(n - 1, 0)]
    while todo:
        r, c = todo.pop(0)
        for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if q not in longest and 0 <= q[0] < n and 0 <= q[1] < n and np.isfinite(a[q]):
                longest[q] = longest[r, c] + 1
                todo.append(q)
    assert {k: v for k, v in got.items() if v is not None} == longest


def _voxels(spark, f, n):
    rows = [(i, j, k, float(f(i + 0.5, j + 0.5, k + 0.5)), 1) for i in range(n) for j in range(n) for k in range(n)]
    return spark.createDataFrame(rows, "ix int, iy int, iz int, value double, weight int")


def _whole(triangles):
    rows = triangles.collect()
    faces = [[tuple(r[f"{c}{k}"] for c in ("ix", "iy", "iz", "d")) for k in "abc"] for r in rows]
    place = {tuple(r[f"{c}{k}"] for c in ("ix", "iy", "iz", "d")): tuple(r[f"{c}{k}"] for c in "xyz") for r in rows for k in "abc"}
    return faces, place


def test_sphere_is_watertight(spark):
    n, radius = 14, 4.7
    df = _voxels(spark, lambda x, y, z: np.hypot(np.hypot(x - 7.1, y - 6.9), z - 7.05) - radius, n)
    faces, place = _whole(meshes.surface_triangles(df.repartition(5), 1.0))
    edges = Counter((f[k], f[(k + 1) % 3]) for f in faces for k in range(3))
    assert set(edges.values()) == {1} and all((b, a) in edges for a, b in edges)
    assert len(place) - len(edges) // 2 + len(faces) == 2
    p = np.array([[place[v] for v in f] for f in faces])
    volume = np.einsum("ni,ni->n", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6
    assert volume == pytest.approx(4 / 3 * np.pi * radius**3, rel=0.03)
    assert np.abs(np.linalg.norm(np.array(list(place.values())) - [7.1, 6.9, 7.05], axis=1) - radius).max() < 0.1


def test_torus_and_noise_close_too(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 1, (9, 9, 9))
    noise[0], noise[-1], noise[:, 0], noise[:, -1], noise[:, :, 0], noise[:, :, -1] = 1, 1, 1, 1, 1, 1
    noise[4, 4, 4] = 0.0
    faces, _ = _whole(meshes.surface_triangles(_voxels(spark, lambda x, y, z: noise[int(x), int(y), int(z)], 9), 2.0))
    edges = Counter((f[k], f[(k + 1) % 3]) for f in faces for k in range(3))
    assert all(edges[b, a] == n for (a, b), n in edges.items()) and len(faces) > 500
    faces, place = _whole(meshes.surface_triangles(_voxels(spark, lambda x, y, z: np.hypot(np.hypot(x - 8, y - 8) - 4.3, z - 8) - 1.9, 16), 1.0))
    edges = {(f[k], f[(k + 1) % 3]) for f in faces for k in range(3)}
    assert len(place) - len(edges) // 2 + len(faces) == 0


def test_ply_holds_the_mesh(spark, tmp_path):
    df = _voxels(spark, lambda x, y, z: np.hypot(np.hypot(x - 4, y - 4), z - 4) - 2.2, 8)
    triangles = meshes.surface_triangles(df, 1.0)
    meshes.write_ply(triangles, str(tmp_path / "mesh"))
    lines = "".join(f.read_text() for part in sorted((tmp_path / "mesh").iterdir()) for f in sorted(part.glob("part-*"))).splitlines()
    body = lines[lines.index("end_header") + 1 :]
    n, m = (int(next(x for x in lines if x.startswith(f"element {w}")).split()[2]) for w in ("vertex", "face"))
    points, faces = np.array([list(map(float, x.split())) for x in body[:n]]), [list(map(int, x.split())) for x in body[n:]]
    assert len(faces) == m == triangles.count() and {f[0] for f in faces} == {3} and {k for f in faces for k in f[1:]} == set(range(n))
    p = points[np.array(faces)[:, 1:]]
    assert np.einsum("ni,ni->n", p[:, 0] - 4, np.cross(p[:, 1] - 4, p[:, 2] - 4)).sum() / 6 == pytest.approx(4 / 3 * np.pi * 2.2**3, rel=0.12)


def test_missing_voxels_and_empty_tables(spark):
    df = _voxels(spark, lambda x, y, z: x - 1.5, 3)
    assert meshes.surface_triangles(df.filter("not (ix = 1 and iy = 1 and iz = 1)"), 1.0).count() == 0
    assert meshes.surface_triangles(df.limit(0), 1.0).count() == 0
    flat = meshes.surface_triangles(df, 1.0).collect()
    assert len(flat) == 32  # four cubes, eight triangles across each
    assert {r[f"x{k}"] for r in flat for k in "abc"} == {1.5}
