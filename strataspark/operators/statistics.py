"""Raster statistics, surface comparison, volumes, fusion by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .quantiles import exact_quantiles, middle

def clean_elevations(cells: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Voids as nulls: the nodata value, not-a-number, and what no terrain has."""
    v = F.col("value")
    return cells.withColumn("value", F.when(v.isNull() | F.isnan(v) | (v == nodata) | (v < -1e5) | (v > 1e6), None).otherwise(v))


def raster_statistics(cells: DataFrame) -> DataFrame:
    """One row over all cells, voids included in ``cells`` and ``coverage``; the median is exact whatever the number of cells."""
    v = F.col("value")
    sums = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(v.isNull()).alias("voids"), (F.count(v) / F.count(F.lit(1))).alias("coverage"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
    )
    return sums.crossJoin(F.broadcast(middle(cells, v, name="median").drop("n")))


def band_statistics(cells: DataFrame) -> DataFrame:
    """Extremes, mean, population deviation and the 2nd and 98th percentile of each band, from all cells."""
    v = F.col("value")
    sums = cells.groupBy("band").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    cuts = exact_quantiles(cells, v, [0.02, 0.98], ["band"])
    return sums.join(cuts, "band", "left").select("band", "low", "high", "mean", "std", F.get("q", F.lit(0)).alias("p2"), F.get("q", F.lit(1)).alias("p98"))


def compare_surfaces(derived: DataFrame, reference: DataFrame) -> DataFrame:
    """Error figures of one surface against another over shared cells, as one row.

    The differences are written once; the normalised median deviation needs their median first, which comes back as a one-row broadcast.
    """
    both = derived.select("row", "col", F.col("value").alias("a")).join(reference.select("row", "col", F.col("value").alias("b")), ["row", "col"])
    d = materialise(both.filter("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b")), "surface-differences")
    mid = F.broadcast(middle(d, "d", name="median").drop("n"))
    spread = F.broadcast(middle(d.crossJoin(mid), F.abs(F.col("d") - F.col("median")), name="mad").drop("n"))
    high = F.broadcast(exact_quantiles(d, F.abs("d"), [0.95]).select(F.get("q", F.lit(0)).alias("p95")))
    sums = d.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max(F.abs("d")).alias("max_abs"),
        F.regr_slope("a", "b").alias("slope"), F.regr_intercept("a", "b").alias("intercept"), F.regr_r2("a", "b").alias("r2"),
    )
    return sums.crossJoin(mid).crossJoin(spread).crossJoin(high).select("n", "rmse", "mean", "std", "max_abs", "median", (1.4826 * F.col("mad")).alias("nmad"), "p95", "slope", "intercept", "r2")


def volume_between(surface: DataFrame, base: DataFrame, cell_area: float) -> DataFrame:
    """Volumes of what stands above (cut) and lies below (fill) the base, over shared cells."""
    d = surface.select("row", "col", F.col("value").alias("a")).join(base.select("row", "col", F.col("value").alias("b")), ["row", "col"]).select((F.col("a") - F.col("b")).alias("d"))
    d = d.filter("d is not null")
    x = F.col("d")
    return d.agg(
        F.count(F.lit(1)).alias("cells"), (F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)) * cell_area).alias("cut"), (F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)) * cell_area).alias("fill"),
        (F.coalesce(F.sum(x), F.lit(0.0)) * cell_area).alias("net"), F.avg(x).alias("mean"), F.max(x).alias("highest"), F.max(-x).alias("deepest"),
    )


def stack(layers: list[DataFrame]) -> DataFrame:
    """Union of cell tables with their place in the list as ``layer``; voids are left out."""
    parts = [c.select("row", "col", "value").withColumn("layer", F.lit(k)) for k, c in enumerate(layers)]
    return reduce(DataFrame.unionByName, parts).filter("value is not null")


def merge(layers: list[DataFrame], how: str = "median") -> DataFrame:
    """One surface of several: ``median``, ``mean``, or ``first`` in the order of the list."""
    value = {"median": F.median("value"), "mean": F.avg("value"), "first": F.min_by("value", "layer")}[how]
    return stack(layers).groupBy("row", "col").agg(value.alias("value"), F.count(F.lit(1)).alias("layers"))


def fuse_by_vote(layers: list[DataFrame], tolerance: float, agree: int = 2, fallback: DataFrame | None = None) -> DataFrame:
    """Mean of the values within ``tolerance`` of the cell's median where ``agree`` or more do, else the fallback."""
    values = F.collect_list("value")
    cells = stack(layers).groupBy("row", "col").agg(F.median("value").alias("m"), values.alias("vs"))
    near = F.filter("vs", lambda v: F.abs(v - F.col("m")) <= tolerance)
    voted = cells.select("row", "col", F.size(near).alias("agreeing"), F.when(F.size(near) >= agree, F.aggregate(F.array_sort(near), F.lit(0.0), lambda s, v: s + v) / F.size(near)).alias("value"))
    if fallback is None:
        return voted
    other = fallback.select("row", "col", F.col("value").alias("other"))
    return voted.join(other, ["row", "col"], "full").select("row", "col", F.coalesce("agreeing", F.lit(0)).alias("agreeing"), F.coalesce("value", "other").alias("value"))


def vertical_offsets(layers: list[DataFrame], least: int = 500):
    """Height to add to each layer so that overlaps agree: medians of pair differences, then least squares with zero sum.

    The pairs come to the driver, one row for each two layers of a list that the caller holds.
    """
    import numpy as np

    s = stack(layers)
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.col") == F.col("b.col")) & (F.col("a.layer") < F.col("b.layer")))
    steps = pairs.select(F.col("a.layer").alias("i"), F.col("b.layer").alias("j"), (F.col("b.value") - F.col("a.value")).alias("step"))
    rows = middle(steps, "step", ["i", "j"], "d").filter(F.col("n") >= least).collect()
    left, right = [np.ones(len(layers))], [0.0]
    for r in rows:
        e = np.zeros(len(layers))
        e[r["i"]], e[r["j"]] = 1.0, -1.0
        left.append(e)
        right.append(r["d"])
    return np.linalg.lstsq(np.array(left), np.array(right), rcond=None)[0]
