"""Triangles of the surface in a table of voxels: marching tetrahedra with vertices named by their lattice edge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .ranks import global_rank

# The corners of a cube by their bits (1: x, 2: y, 4: z); six tetrahedra around the diagonal from 0 to 7 fill it alike in all cubes, so faces of neighbours match.
TETRAHEDRA = [(0, a, a | b, 7) for a, b in ((1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2))]
VERTEX = [f"{c}{k}" for k in "abc" for c in ("ix", "iy", "iz", "d", "x", "y", "z")]
FACE = ", ".join(f"{c} {'double' if c[0] in 'xyz' else 'long'}" for c in VERTEX)


def _march(size: float):
    """Triangles of a batch of cubes (``ix, iy, iz, v``: eight values by the bits of the corner)."""
    bits = np.array([[k & 1, k >> 1 & 1, k >> 2 & 1] for k in range(8)])

    def run(batches):
        for batch in batches:
            base = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            v = batch.column(3).flatten().to_numpy().reshape(-1, 8)
            out = [[] for _ in range(3)]
            for tet in TETRAHEDRA:
                p = bits[list(tet)]
                turned = np.linalg.det(p[1:] - p[0]) < 0
                inside = v[:, tet] < 0
                for case in range(1, 15):
                    rows = np.flatnonzero((inside == [bool(case >> k & 1) for k in range(4)]).all(1))
                    if not len(rows):
                        continue
                    low, high = [k for k in range(4) if case >> k & 1], [k for k in range(4) if not case >> k & 1]
                    if len(low) == 2:
                        (a, b), (c, d) = low, high
                        faces = [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
                        odd = _odd((a, b, c, d))
                    else:
                        lone, rest = (low[0], high) if len(low) == 1 else (high[0], low)
                        faces = [tuple((lone, k) for k in rest)]
                        odd = _odd((lone, *rest)) ^ (len(low) == 3)
                    for face in faces:
                        if odd ^ turned:
                            face = face[::-1]
                        for n, (i, j) in enumerate(face):
                            i, j = sorted((tet[i], tet[j]))  # corners of a tetrahedron lie in order along the diagonal
                            share = v[rows, i] / (v[rows, i] - v[rows, j])
                            at = base[rows] + bits[i]
                            where = (at + 0.5 + share[:, None] * (bits[j] - bits[i])) * size
                            out[n].append((at, np.full(len(rows), j & ~i), where))
            cols = []
            for n in range(3):
                at = np.concatenate([o[0] for o in out[n]] or [np.zeros((0, 3), np.int64)])
                way = np.concatenate([o[1] for o in out[n]] or [np.zeros(0, np.int64)])
                where = np.concatenate([o[2] for o in out[n]] or [np.zeros((0, 3))])
                cols += [pa.array(at[:, k].astype(np.int64)) for k in range(3)] + [pa.array(way.astype(np.int64))] + [pa.array(where[:, k].astype(float)) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=VERTEX)

    return run


def _odd(order: tuple[int, ...]) -> bool:
    return sum(a > b for k, b in enumerate(order) for a in order[:k]) % 2 == 1


def surface_triangles(fused: DataFrame, size: float, least: int = 1) -> DataFrame:
    """Triangles where ``value`` changes its sign, seen counter-clockwise from the positive side: three corners, each with its name ``ix, iy, iz, d`` and place ``x, y, z``.

    ``fused`` has ``ix, iy, iz, value, weight``. A corner lies on the lattice edge from a voxel in the direction ``d`` (bits of x, y, z), and is
    the same for all cubes around, so the triangles of all tasks join without a search. Cubes with a missing voxel have none.
    One shuffle: each voxel goes to the eight cubes that it is a corner of.
    """
    ship_package(fused.sparkSession)
    v = fused.filter((F.col("weight") >= least) & F.col("value").isNotNull()).select(*[F.col(c).cast("long").alias(c) for c in ("ix", "iy", "iz")], F.col("value").cast("double").alias("value"))
    corner = F.explode(F.array(*[F.lit(k) for k in range(8)]))
    sent = v.withColumn("k", corner).select(
        (F.col("ix") - F.col("k").bitwiseAND(F.lit(1))).alias("ix"), (F.col("iy") - F.shiftright("k", 1).bitwiseAND(F.lit(1))).alias("iy"), (F.col("iz") - F.shiftright("k", 2).bitwiseAND(F.lit(1))).alias("iz"), "k", "value"
    )
    cubes = sent.groupBy("ix", "iy", "iz").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(8)])
    corners = [f"v{k}" for k in range(8)]
    crossed = cubes.dropna(subset=corners).filter((F.least(*corners) < 0) & (F.greatest(*corners) >= 0))
    return crossed.select("ix", "iy", "iz", F.array(*corners).alias("v")).mapInArrow(_march(size), FACE)


def vertices_and_faces(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertex, x, y, z`` numbered from 0 in order of their names, and ``a, b, c`` of each triangle by these numbers.

    A value of exactly 0 puts several corners on one place; they keep their own names, so the mesh stays whole.
    """
    name = ["ix", "iy", "iz", "d"]
    every = None
    for k in "abc":
        one = triangles.select(*[F.col(f"{c}{k}").alias(c) for c in (*name, "x", "y", "z")])
        every = one if every is None else every.unionByName(one)
    distinct = every.groupBy(*name).agg(*[F.min(c).alias(c) for c in "xyz"])
    numbered = global_rank(distinct, name, "vertex")
    faces = triangles.select(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in name]).alias(f"n{k}") for k in "abc"])
    for k in "abc":
        key = numbered.select(F.struct(*name).alias(f"m{k}"), F.col("vertex").alias(k))
        faces = faces.join(key, faces[f"n{k}"] == key[f"m{k}"])
    return numbered.select("vertex", "x", "y", "z"), faces.select("a", "b", "c")


def write_ply(triangles: DataFrame, path: str) -> None:
    """A text PLY as a folder of files whose contents, joined in order of their names, are the file: head, vertices, faces.

    Each task writes its own range of vertices or faces, so no one holds the mesh.
    """
    spark = triangles.sparkSession
    vertices, faces = vertices_and_faces(triangles)
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *[f"property double {c}" for c in "xyz"], f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"]
    spark.createDataFrame([(k, line) for k, line in enumerate(head)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/0-head")
    vertices.repartitionByRange("vertex").sortWithinPartitions("vertex").select(F.concat_ws(" ", "x", "y", "z").alias("value")).write.text(f"{path}/1-vertices")
    faces.select(F.concat_ws(" ", F.lit("3"), "a", "b", "c").alias("value")).write.text(f"{path}/2-faces")
