"""Gridding of points: cell keys, per-cell aggregates, lattices, voxels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOW = ("min", "max", "mean", "median", "count", "idw", "nearest")


@dataclass(frozen=True)
class Grid:
    """North-up grid: row 0 is at the north edge; cells are ``cell_x`` by ``cell_y``."""

    west: float
    north: float
    cell_x: float
    cell_y: float
    cols: int
    rows: int

    @classmethod
    def over(cls, west: float, south: float, east: float, north: float, cell_x: float, cell_y: float | None = None) -> Grid:
        """Grid over bounds, snapped outward to whole cells, with one more cell beyond the far edges."""
        cell_y = cell_y or cell_x
        w, s = math.floor(west / cell_x) * cell_x, math.floor(south / cell_y) * cell_y
        cols, rows = math.floor(east / cell_x) + 1 - math.floor(west / cell_x), math.floor(north / cell_y) + 1 - math.floor(south / cell_y)
        return cls(w, s + rows * cell_y, cell_x, cell_y, max(1, cols), max(1, rows))

    @classmethod
    def around(cls, points: DataFrame, cell_x: float, cell_y: float | None = None, x: str = "x", y: str = "y") -> Grid:
        b = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).head()
        return cls.over(b[0], b[1], b[2], b[3], cell_x, cell_y)

    def col(self, x: Column) -> Column:
        """Column number; points beyond the bounds fall into the edge cells."""
        return F.greatest(F.lit(0), F.least(F.lit(self.cols - 1), ((x - self.west) / self.cell_x).cast("int")))

    def row(self, y: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.rows - 1), ((self.north - y) / self.cell_y).cast("int")))

    def centre_x(self, col: Column) -> Column:
        return self.west + (col + 0.5) * self.cell_x

    def centre_y(self, row: Column) -> Column:
        return self.north - (row + 0.5) * self.cell_y


def with_cells(points: DataFrame, grid: Grid) -> DataFrame:
    return points.withColumns({"row": grid.row(F.col("y")), "col": grid.col(F.col("x"))})


def grid_aggregate(points: DataFrame, grid: Grid, how: str = "mean", power: float = 2.0, order: list[str] | None = None) -> DataFrame:
    """``row, col, value, n`` of the occupied cells, from points with ``x, y, z``.

    ``nearest`` takes the point nearest the cell centre, ties by ``order`` (then the least z); ``idw`` weighs by
    ``1 / max(distance, 0.01 cell) ** power``. One partial and one final hash aggregate, whatever the method.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    cells = with_cells(points, grid)
    dx, dy = F.col("x") - grid.centre_x(F.col("col")), F.col("y") - grid.centre_y(F.col("row"))
    away = F.sqrt(dx * dx + dy * dy)
    weight = 1 / F.pow(F.greatest(away, F.lit(0.01 * grid.cell_x)), F.lit(power))
    value = {
        "min": lambda: F.min("z"),
        "max": lambda: F.max("z"),
        "mean": lambda: F.avg("z"),
        "median": lambda: F.median("z"),
        "count": lambda: F.count("z").cast("double"),
        "idw": lambda: F.sum(F.col("z") * weight) / F.sum(weight),
        "nearest": lambda: F.min_by("z", F.struct(away.alias("d"), *(order or []), "z")),
    }[how]()
    return cells.filter(F.col("z").isNotNull()).groupBy("row", "col").agg(value.alias("value"), F.count(F.lit(1)).alias("n"))


def lattice(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of the grid, made by the executors."""
    return spark.range(grid.rows * grid.cols).select((F.col("id") / grid.cols).cast("int").alias("row"), (F.col("id") % grid.cols).cast("int").alias("col"))


def complete(cells: DataFrame, grid: Grid) -> DataFrame:
    """Occupied cells and the empty ones, whose value is null."""
    return lattice(cells.sparkSession, grid).join(cells, ["row", "col"], "left")


def highest_per_cell(points: DataFrame, grid: Grid, order: list[str], keep: list[str]) -> DataFrame:
    """The whole highest point of each cell (``keep`` names its columns); ties go to the first by ``order``."""
    best = F.max_by(F.struct(*keep), F.struct(F.col("z"), *[(-F.col(c)).alias(f"o{k}") for k, c in enumerate(order)]))
    return with_cells(points, grid).groupBy("row", "col").agg(best.alias("p")).select("row", "col", "p.*")


def voxel_key(ix: Column, iy: Column, iz: Column) -> Column:
    """21 bits an axis in one long, offset so that negative indices order first."""
    part = lambda c: (c.cast("long") + F.lit(1 << 20)).bitwiseAND(F.lit((1 << 21) - 1))
    return F.shiftleft(part(ix), 42).bitwiseOR(F.shiftleft(part(iy), 21)).bitwiseOR(part(iz))


def voxel_index(key: Column) -> list[Column]:
    """The three indices packed in a key."""
    return [(F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << 21) - 1)) - F.lit(1 << 20)).cast("int") for s in (42, 21, 0)]


def voxel_mean(points: DataFrame, size: tuple[float, float, float], values: list[str]) -> DataFrame:
    """One row a voxel: key, count and the mean of each value column."""
    key = voxel_key(*[F.floor(F.col(c) / s) for c, s in zip("xyz", size, strict=True)])
    return points.groupBy(key.alias("voxel")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def keep_points(points: DataFrame, classes: list[int] | None = None, returns: str = "all", noise: bool = False) -> DataFrame:
    """Class and return filter; noise (classes 7 and 18) stays only if asked for, or named in ``classes``."""
    number, total = F.col("return_number"), F.col("number_of_returns")
    tests = {"all": F.lit(True), "first": number == 1, "last": number == total, "single": total == 1}
    if returns not in tests:
        raise ValueError(f"returns must be one of {', '.join(tests)}")
    kept = points.filter(tests[returns])
    if classes:
        return kept.filter(F.col("classification").isin(classes))
    return kept if noise else kept.filter(~F.col("classification").isin(7, 18))


def section(points: DataFrame, start: tuple[float, float], end: tuple[float, float], width: float, most: int | None = None, order: str = "index") -> DataFrame:
    """Points of a corridor as ``along, across``; above ``most`` they are thinned to even ranks along it."""
    (x0, y0), (x1, y1) = start, end
    length = math.hypot(x1 - x0, y1 - y0)
    if not length:
        raise ValueError("a section needs two different ends")
    ux, uy = (x1 - x0) / length, (y1 - y0) / length
    dx, dy = F.col("x") - x0, F.col("y") - y0
    cut = points.withColumns({"along": dx * ux + dy * uy, "across": dy * ux - dx * uy}).filter(F.col("along").between(0, length) & (F.abs("across") <= width / 2))
    if most is None:
        return cut
    total = cut.count()
    if total <= most:
        return cut
    from .ranks import global_rank

    ranked = global_rank(cut, ["along", order], "rank")
    # rank r is one of ``most`` even places if some k has round(k * (total - 1) / (most - 1)) = r
    step = (total - 1) / (most - 1)
    k = F.round(F.col("rank") / step)
    return ranked.filter(F.round(k * step) == F.col("rank")).drop("rank")
