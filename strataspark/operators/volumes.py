"""Depth maps and voxels: consensus of depths, and their fusion into a signed distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_consensus(depths: DataFrame, tolerance: float = 0.01, bounds: DataFrame | None = None) -> DataFrame:
    """One depth a cell: ``image_id, row, col, depth, agree`` from the depths that each of a photo's partners gives.

    The mean of those within ``tolerance`` (a share) of their median; ``agree`` counts them. ``bounds`` (``image_id, near,
    far``) drops what lies outside. A cell has a depth for each partner of its photo, of which there are few, so
    they meet in one array; cells without a depth give no row.
    """
    cells = depths.filter("depth is not null and not isnan(depth)").groupBy("image_id", "row", "col").agg(F.array_sort(F.collect_list("depth")).alias("all"))
    n = F.size("all")
    middle = (F.get("all", ((n - 1) / 2).cast("int")) + F.get("all", (n / 2).cast("int"))) / 2
    near = cells.withColumn("middle", middle).withColumn("near", F.expr(f"filter(all, v -> abs(v - middle) <= {float(tolerance)!r}D * middle)"))
    total = F.aggregate("near", F.lit(0.0), lambda s, v: s + v)
    found = near.filter(F.size("near") > 0).select("image_id", "row", "col", (total / F.size("near")).alias("depth"), F.size("near").cast("long").alias("agree"))
    if bounds is None:
        return found
    limits = bounds.select(F.col("image_id").alias("__image"), "near", "far")
    kept = found.join(limits, found["image_id"] == limits["__image"], "left")
    inside = F.col("near").isNull() | F.col("depth").between(F.col("near"), F.col("far"))
    return kept.filter(inside).select("image_id", "row", "col", "depth", "agree")


def fuse_distances(seen: DataFrame, truncation: float, colours: list[str] | None = None) -> DataFrame:
    """``voxel, value, weight`` and mean colours, from what each photo sees of each voxel: ``sdf``, measured depth less the voxel's.

    In front of the surface a photo counts as far as it sees, behind it only to ``truncation``; distances are cut to that
    and scaled to -1..1. The running mean of one photo after another is the mean, so it is one aggregate, combined before the
    shuffle. Colours are means over the photos that see the voxel within the truncation.
    """
    t = F.lit(float(truncation))
    use = seen.filter(F.col("sdf").isNotNull() & ~F.isnan("sdf") & (F.col("sdf") > -t))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sdf") / t))
    near = F.abs("sdf") < t
    return use.groupBy("voxel").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("weight"), *[F.avg(F.when(near, F.col(c))).alias(c) for c in colours or ()])


def surface_voxels(fused: DataFrame, size: float, least: int = 1) -> DataFrame:
    """Crossings of the surface between voxels that adjoin along an axis: ``x, y, z`` in the units of ``size``.

    ``fused`` has ``ix, iy, iz, value, weight``. Where the sign changes the place is interpolated; one equi-join an axis.
    """
    v = fused.filter(F.col("weight") >= least).select("ix", "iy", "iz", "value")
    out = None
    for k, axis in enumerate(("ix", "iy", "iz")):
        other = v.select(*[(F.col(c) - int(c == axis)).alias(c) for c in ("ix", "iy", "iz")], F.col("value").alias("next"))
        cross = v.join(other, ["ix", "iy", "iz"]).filter((F.col("value") < 0) != (F.col("next") < 0))
        share = F.col("value") / (F.col("value") - F.col("next"))
        one = cross.select(*[((F.col(c) + 0.5 + (share if j == k else 0.0)) * size).alias(n) for j, (c, n) in enumerate(zip(("ix", "iy", "iz"), "xyz", strict=True))])
        out = one if out is None else out.unionByName(one)
    return out
