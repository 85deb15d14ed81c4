"""Neighbourhood operators on cell tables ``row, col, value``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def _across():
    return Window.partitionBy("row").orderBy("col")


def _down():
    return Window.partitionBy("col").orderBy("row")


def three_by_three(cells: DataFrame) -> DataFrame:
    """Each cell of a full lattice with its eight neighbours as ``nw n ne w e sw s se``; edges repeat.

    Two window passes: along rows, then down columns over the triples of the first.
    """
    rows = cells.withColumns({"w": F.coalesce(F.lag("value").over(_across()), "value"), "e": F.coalesce(F.lead("value").over(_across()), "value")})
    triple = F.struct("w", "value", "e")
    both = rows.withColumns({"up": F.coalesce(F.lag(triple).over(_down()), triple), "down": F.coalesce(F.lead(triple).over(_down()), triple)})
    return both.select("row", "col", "value", "w", "e", F.col("up.w").alias("nw"), F.col("up.value").alias("n"), F.col("up.e").alias("ne"), F.col("down.w").alias("sw"), F.col("down.value").alias("s"), F.col("down.e").alias("se"))


def hillshade(cells: DataFrame, cell_x: float, cell_y: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """Shade 0..255 of each cell by Horn's gradient; voids count as the mean height and are shaded 0."""
    mean = cells.agg(F.avg("value").alias("mean"))
    filled = cells.crossJoin(F.broadcast(mean)).select("row", "col", F.coalesce("value", "mean").alias("value"), F.col("value").isNull().alias("void"))
    near = three_by_three(filled.select("row", "col", "value")).join(filled.select("row", "col", "void"), ["row", "col"])
    dx = ((F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))) / (8 * cell_x) * z_factor
    dy = ((F.col("nw") + 2 * F.col("n") + F.col("ne")) - (F.col("sw") + 2 * F.col("s") + F.col("se"))) / (8 * cell_y) * z_factor
    az, alt = math.radians(azimuth), math.radians(altitude)
    light = (math.sin(alt) - math.cos(alt) * (math.sin(az) * dx + math.cos(az) * dy)) / F.sqrt(1 + dx * dx + dy * dy)
    return near.select("row", "col", F.when(F.col("void"), 0).otherwise((F.greatest(F.lit(0.0), F.least(F.lit(1.0), light)) * 255).cast("int")).alias("shade"))


def gradient(cells: DataFrame, cell_x: float, cell_y: float) -> DataFrame:
    """Slope of a full lattice by central differences, one-sided at the edges."""

    def difference(window, size: float) -> Column:
        back, fore = F.lag("value").over(window), F.lead("value").over(window)
        steps = F.when(F.lag("col").over(window).isNull() | F.lead("col").over(window).isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(fore, "value") - F.coalesce(back, "value")) / (steps * size)

    d = cells.withColumns({"gx": difference(_across(), cell_x), "gy": difference(_down(), cell_y)})
    return d.select("row", "col", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("slope"))


def halo(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each value sent to all cells that it is a neighbour of; ``offsets`` are (rows, columns)."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    return cells.select(F.explode(steps).alias("o"), "row", "col", "value").select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "value")


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def median_filter(cells: DataFrame, size: int = 3) -> DataFrame:
    """Median of the filled neighbours where at least a third are; other cells become voids."""
    near = halo(cells.filter("value is not null"), square(size)).groupBy("row", "col").agg(F.median("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return cells.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.when(F.col("n") * 3 >= size * size, F.col("m")).alias("value"))


def _separable(cells: DataFrame, radius: int, reduce_) -> DataFrame:
    frame = lambda w: w.rowsBetween(-radius, radius)
    once = cells.withColumn("value", reduce_("value").over(frame(_across())))
    return once.withColumn("value", reduce_("value").over(frame(_down())))


def uniform_filter(cells: DataFrame, size: int = 3) -> DataFrame:
    """Mean of the filled neighbours of a full lattice, voids kept; sums and counts go through both passes."""
    r = size // 2
    across, down = _across().rowsBetween(-r, r), _down().rowsBetween(-r, r)
    once = cells.withColumns({"s": F.sum("value").over(across), "k": F.count("value").over(across)})
    return once.withColumns({"ss": F.sum("s").over(down), "kk": F.sum("k").over(down)}).select("row", "col", F.when(F.col("value").isNotNull(), F.col("ss") / F.col("kk")).alias("value"))


def gaussian_filter(cells: DataFrame, size: int = 5) -> DataFrame:
    """Normalised Gaussian (sigma a third of ``size``) of a full lattice: blurred values over blurred presence."""
    sigma = size / 3
    r = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]

    def blur(window, name: str) -> Column:
        total = None
        for k, w in zip(range(-r, r + 1), weights, strict=True):
            term = F.coalesce(F.lag(name, -k).over(window), F.lit(0.0)) * w
            total = term if total is None else total + term
        return total

    start = cells.withColumns({"v": F.coalesce("value", F.lit(0.0)), "m": F.col("value").isNotNull().cast("double")})
    once = start.withColumns({"v1": blur(_across(), "v"), "m1": blur(_across(), "m")})
    twice = once.withColumns({"v2": blur(_down(), "v1"), "m2": blur(_down(), "m1")})
    return twice.select("row", "col", F.when(F.col("value").isNotNull(), F.col("v2") / F.col("m2")).alias("value"))


def opening_square(cells: DataFrame, size: int) -> DataFrame:
    """Grey opening of a full lattice: least, then greatest of the square; the edge is as if repeated."""
    return _separable(_separable(cells, size // 2, F.min), size // 2, F.max)


def opening_disk(cells: DataFrame, radius: int) -> DataFrame:
    """Grey opening with a disk, by halo and aggregate."""
    filled = cells.filter("value is not null")
    low = halo(filled, disk(radius)).groupBy("row", "col").agg(F.min("value").alias("value")).join(filled.select("row", "col"), ["row", "col"])
    return halo(low, disk(radius)).groupBy("row", "col").agg(F.max("value").alias("value")).join(filled.select("row", "col"), ["row", "col"])


def wallis(cells: DataFrame, size: int, mean: float = 127.0, std: float = 60.0) -> DataFrame:
    """Local contrast of a full lattice brought to a mean and deviation, its gain kept from 0.3 to 4."""
    r = size // 2
    across, down = _across().rowsBetween(-r, r), _down().rowsBetween(-r, r)
    v = F.col("value")
    once = cells.withColumns({"s": F.sum(v).over(across), "q": F.sum(v * v).over(across), "k": F.count(v).over(across)})
    twice = once.withColumns({"ss": F.sum("s").over(down), "qq": F.sum("q").over(down), "kk": F.sum("k").over(down)})
    local = F.col("ss") / F.col("kk")
    deviation = F.sqrt(F.greatest(F.col("qq") / F.col("kk") - local * local, F.lit(0.0)))
    gain = F.greatest(F.lit(0.3), F.least(F.lit(4.0), std / F.greatest(deviation, F.lit(1e-6))))
    return twice.select("row", "col", ((v - local) * gain + mean).alias("value"))


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    """Average of ``factor`` by ``factor`` cells: windows read at a lower resolution, and display pyramids."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def bilinear(cells: DataFrame, points: DataFrame, west: float, north: float, cell_x: float, cell_y: float, key: str) -> DataFrame:
    """``key, value`` at points ``x, y`` between the four nearest cell centres; null beside voids and beyond the centres.

    Points are spread to their four corners and meet the cells in one equi-join.
    """
    fx, fy = (F.col("x") - west) / cell_x - 0.5, (north - F.col("y")) / cell_y - 0.5
    at = points.select(key, fx.alias("fx"), fy.alias("fy")).withColumns({"c0": F.floor("fx").cast("int"), "r0": F.floor("fy").cast("int")})
    tx, ty = F.col("fx") - F.col("c0"), F.col("fy") - F.col("r0")
    corners = F.array(*[
        F.struct((F.col("r0") + a).alias("row"), (F.col("c0") + b).alias("col"), ((ty if a else 1 - ty) * (tx if b else 1 - tx)).alias("w")) for a in (0, 1) for b in (0, 1)
    ])
    spread = at.select(key, F.explode(corners).alias("k")).select(key, "k.*").filter("w > 0")
    met = spread.join(cells.select("row", "col", "value"), ["row", "col"], "left")
    return met.groupBy(key).agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("w") * F.col("value"))).alias("value"))


def stretch(cells: DataFrame, mode: str = "linear", gamma: float = 1.0) -> DataFrame:
    """Values as 0..255: ``linear``, ``linear2pct``, ``stddev`` (two deviations) or ``root``; one row of statistics is broadcast."""
    v = F.col("value")
    stats = cells.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))
    if mode == "linear2pct":
        cuts = exact_quantiles(cells, v, [0.02, 0.98])
        stats = stats.crossJoin(F.broadcast(cuts.select(F.get("q", F.lit(0)).alias("p2"), F.get("q", F.lit(1)).alias("p98"))))
    low, high = {"linear": ("lo", "hi"), "root": ("lo", "hi"), "linear2pct": ("p2", "p98"), "stddev": (None, None)}[mode]
    lo = F.col(low) if low else F.col("mu") - 2 * F.col("sd")
    hi = F.col(high) if high else F.col("mu") + 2 * F.col("sd")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.greatest(hi - lo, F.lit(1e-12))))
    share = F.sqrt(share) if mode == "root" else share
    return cells.crossJoin(F.broadcast(stats)).select("row", "col", F.floor(F.pow(share, F.lit(1.0 / gamma)) * 255 + 1e-6).cast("int").alias("value"))


def bare_earth(cells: DataFrame, cell: float, most: int = 33, slope: float = 0.4, first: float = 0.5, last: float = 8.0) -> DataFrame:
    """Progressive morphological filter of a full lattice: cells that an opening of windows 3, 7, 15, .. lowers by
    more than a growing tolerance are objects. Returns ``row, col, value, ground``."""
    from ..session import materialise

    now = cells.select("row", "col", "value", F.lit(True).alias("ground"), F.col("value").alias("surface"))
    before, size = 1, 3
    while size <= most:
        tolerance = min(first + slope * (size - before) * cell, last)
        opened = opening_square(now.select("row", "col", F.col("surface").alias("value")), size).withColumnRenamed("value", "opened")
        met = now.join(opened, ["row", "col"])
        now = materialise(
            met.select("row", "col", "value", (F.col("ground") & (F.col("surface") - F.col("opened") <= tolerance)).alias("ground"), F.col("opened").alias("surface")), "bare-earth"
        )
        before, size = size, 2 * size + 1
    return now.select("row", "col", "value", "ground")
