"""Terrain pipelines on cell tables and clouds: void filling, ground, heights, profiles, orthophotos."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import project
from ..operators.grid import Grid, complete, grid_aggregate, keep_points
from ..operators.polylines import chained, simplified
from ..operators.stencils import bilinear, disk, gradient, halo, median_filter, opening_disk
from ..session import materialise


def nearest_filled(cells: DataFrame, radius: int) -> DataFrame:
    """Of each cell of a full lattice the squared distance ``d2`` (in cells) to the nearest filled one within ``radius``, and its value.

    Exact and separable: the nearest filled cells to the left and right within the row, then the best of
    the column's rows. Ties go to the lesser value. Filled cells are their own nearest.
    """
    filled = F.when(F.col("value").isNotNull(), F.struct("col", "value"))
    across = Window.partitionBy("row").orderBy("col")
    rows = cells.select("row", "col", "value", F.last(filled, True).over(across.rowsBetween(-radius, 0)).alias("l"), F.first(filled, True).over(across.rowsBetween(0, radius)).alias("r"))
    sides = rows.select("row", "col", F.explode(F.array_compact(F.array("l", "r"))).alias("s")).filter(F.abs(F.col("s.col") - F.col("col")) <= radius)
    best = sides.groupBy("row", "col").agg(F.min(F.struct(F.pow(F.col("s.col") - F.col("col"), F.lit(2)).cast("long").alias("d2"), F.col("s.value").alias("value"))).alias("b"))
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    spread = best.select(F.explode(steps).alias("k"), "row", "col", "b").select((F.col("row") + F.col("k")).alias("row"), "col", F.struct((F.col("b.d2") + F.col("k") * F.col("k")).alias("d2"), F.col("b.value").alias("value")).alias("b"))
    near = spread.filter(F.col("b.d2") <= radius * radius).groupBy("row", "col").agg(F.min("b").alias("b"))
    return cells.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", "b.d2", "b.value")


def fill_voids(cells: DataFrame, radius: int, how: str = "nearest", power: float = 2.0) -> DataFrame:
    """Voids within ``radius`` of a filled cell get a value: that of the nearest, or ``idw``, the weighted mean of those within the radius."""
    if how == "nearest":
        return nearest_filled(cells, radius).select("row", "col", "value")
    if how != "idw":
        raise ValueError("how must be nearest or idw")
    voids = cells.filter("value is null").select("row", "col")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1.0 / (a * a + b * b) ** (power / 2)).alias("w")) for a, b in disk(radius) if a or b])
    near = cells.filter("value is not null").select(F.explode(steps).alias("s"), "row", "col", "value")
    sent = near.select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("s.w").alias("w"), "value")
    made = sent.join(voids, ["row", "col"], "left_semi").groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("made"))
    return cells.join(made, ["row", "col"], "left").select("row", "col", F.coalesce("value", "made").alias("value"))


def fill_all(cells: DataFrame) -> DataFrame:
    """All voids of a full lattice by the nearest filled cell, with radii that double until none is left; a lattice without a value stays as it is."""
    radius, now = 4, cells.select("row", "col", "value")
    while True:
        now = materialise(fill_voids(now, radius), "filled")
        if now.filter("value is null").isEmpty() or now.filter("value is not null").isEmpty():
            return now
        radius *= 2


def classify_ground(points: DataFrame, grid: Grid, slope: float = 0.15, window: float = 18.0, threshold: float = 0.5, scalar: float = 1.25, low: float | None = 2.0, key: str = "index") -> DataFrame:
    """Ground filter on a least surface: ``points`` with new classes.

    Low noise lies ``low`` under the median of the least heights around; disks of growing radius open the surface, and what stands
    over it by more than the slope allows is an object. Points near the ground between become class 2, low noise 7,
    former ground 1; known noise is left alone.
    """
    use = points.filter(~F.col("classification").isin(7, 18))
    least = lambda p: complete(grid_aggregate(p, grid, "min").select("row", "col", "value"), grid)
    surface = fill_all(least(use))
    marked = points.withColumn("low", F.lit(False))
    if low is not None:
        around = fill_all(median_filter(surface, 5))
        at = _sample(around, points, grid, key).withColumnRenamed("value", "around")
        marked = points.join(at, key).withColumn("low", ~F.col("classification").isin(7, 18) & (F.col("z") < F.col("around") - low)).drop("around")
        marked = materialise(marked, "low-noise")
        surface = fill_all(least(marked.filter(~F.col("low") & ~F.col("classification").isin(7, 18))))
    now = materialise(surface.select("row", "col", "value", F.lit(False).alias("object"), F.col("value").alias("last")), "opening")
    for radius in range(1, max(1, math.ceil(window / grid.cell_x)) + 1):
        opened = opening_disk(now.select("row", "col", F.col("last").alias("value")), radius).withColumnRenamed("value", "opened")
        met = now.join(opened, ["row", "col"])
        now = materialise(met.select("row", "col", "value", (F.col("object") | (F.col("last") - F.col("opened") > slope * radius * grid.cell_x)).alias("object"), F.col("opened").alias("last")), "opening")
    ground = fill_all(now.select("row", "col", F.when(~F.col("object"), F.col("value")).alias("value")))
    steep = gradient(ground, grid.cell_x, grid.cell_y).withColumnRenamed("slope", "value")
    h = _sample(ground, marked, grid, key).withColumnRenamed("value", "ground")
    s = _sample(steep, marked, grid, key).withColumnRenamed("value", "steep")
    met = marked.join(h, key).join(s, key)
    noise = F.col("classification").isin(7, 18)
    is_ground = ~noise & ~F.col("low") & (F.abs(F.col("z") - F.col("ground")) <= threshold + scalar * F.col("steep"))
    new = F.when(F.col("low"), 7).when(is_ground, 2).when(F.col("classification") == 2, 1).otherwise(F.col("classification"))
    return met.withColumn("classification", F.when(noise, F.col("classification")).otherwise(new).cast("short")).select(*points.columns)


def _sample(cells: DataFrame, points: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Bilinear values at points, the edge cells reaching outward: points are first drawn in to the outermost centres."""
    inside = points.select(
        key,
        F.greatest(F.lit(grid.west + grid.cell_x / 2), F.least(F.lit(grid.west + (grid.cols - 0.5) * grid.cell_x), F.col("x"))).alias("x"),
        F.greatest(F.lit(grid.north - (grid.rows - 0.5) * grid.cell_y), F.least(F.lit(grid.north - grid.cell_y / 2), F.col("y"))).alias("y"),
    )
    return bilinear(cells, inside, grid.west, grid.north, grid.cell_x, grid.cell_y, key)


def height_above_ground(points: DataFrame, grid: Grid, most: float = 100.0, key: str = "index") -> DataFrame:
    """Greatest height over the ground (mean grid of class 2, all filled) in each cell; noise and what is over ``most`` is left out."""
    ground = fill_all(complete(grid_aggregate(keep_points(points, [2]), grid, "mean").select("row", "col", "value"), grid))
    use = keep_points(points)
    over = use.join(_sample(ground, use, grid, key), key).withColumn("z", F.greatest(F.col("z") - F.col("value"), F.lit(0.0))).drop("value")
    return grid_aggregate(over.filter(F.col("z") <= most), grid, "max")


def profile(cells: DataFrame, grid: Grid, line: list[tuple[float, float]], samples: int) -> DataFrame:
    """Equally spaced heights along a line: ``sample, distance, x, y, elevation, gradient`` (central, ends null)."""
    if len(line) < 2:
        raise ValueError("a profile needs two points or more")
    lengths = [math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(line, line[1:], strict=False)]
    total = sum(lengths)
    if not total:
        raise ValueError("the line has no length")
    samples, spark = max(8, samples), cells.sparkSession
    begins = [sum(lengths[:k]) for k in range(len(lengths))]
    distance = F.col("id") * total / (samples - 1)
    legs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in (("d", d), ("n", n), ("x", a[0]), ("y", a[1]), ("dx", b[0] - a[0]), ("dy", b[1] - a[1]))]) for d, n, a, b in zip(begins, lengths, line, line[1:], strict=False) if n])
    at = spark.range(samples).select(F.col("id").alias("sample"), distance.alias("distance"))
    at = at.withColumn("leg", F.element_at(F.filter(legs, lambda g: g["d"] <= F.col("distance")), -1))
    share = F.least(F.lit(1.0), (F.col("distance") - F.col("leg.d")) / F.col("leg.n"))
    at = at.select("sample", "distance", (F.col("leg.x") + share * F.col("leg.dx")).alias("x"), (F.col("leg.y") + share * F.col("leg.dy")).alias("y"))
    z = bilinear(cells, at, grid.west, grid.north, grid.cell_x, grid.cell_y, "sample").withColumnRenamed("value", "elevation")
    order = Window.orderBy("sample")  # a line's samples, set by the caller
    slope = (F.lead("elevation").over(order) - F.lag("elevation").over(order)) / (2 * total / (samples - 1))
    return at.join(z, "sample").withColumn("gradient", slope)


def orthorectify(dem: DataFrame, grid: Grid, image: DataFrame, width: int, height: int, pitch_mm: float, focal_mm: float, exterior: tuple[float, ...], how: str = "bilinear") -> DataFrame:
    """Backward projection of every cell of a DEM into a digital photo: ``row, col, value``, null beyond the frame or behind the lens.

    ``image`` has ``row, col, value`` with pixel centres at whole numbers; film rows grow upward from the frame's middle.
    """
    x0, y0, z0, *angles = exterior
    ground = [grid.centre_x(F.col("col")), grid.centre_y(F.col("row")), F.col("value")]
    u, v = project(ground, [F.lit(x0), F.lit(y0), F.lit(z0)], [F.lit(a) for a in angles], F.lit(focal_mm))
    at = dem.filter("value is not null").filter(F.col("value") < z0).select("row", "col", (u / pitch_mm + (width - 1) / 2).alias("px"), ((height - 1) / 2 - v / pitch_mm).alias("py"))
    at = at.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    if how == "nearest":
        source = image.select(F.col("row").alias("r"), F.col("col").alias("c"), "value")
        met = at.withColumns({"r": F.rint("py").cast("int"), "c": F.rint("px").cast("int")}).join(source, ["r", "c"], "left")
        return met.select("row", "col", "value")
    key = (F.col("row").cast("long") * grid.cols + F.col("col")).alias("cell")
    points = at.select(key, (F.col("px") + 0.5).alias("x"), (height - F.col("py") - 0.5).alias("y"))
    got = bilinear(image, points, 0.0, float(height), 1.0, 1.0, "cell")
    return got.select((F.col("cell") / grid.cols).cast("int").alias("row"), (F.col("cell") % grid.cols).cast("int").alias("col"), "value")


def contour_edges(cells: DataFrame, interval: float, base: float = 0.0, index_every: int = 5) -> DataFrame:
    """Crossings of contour levels between neighbouring cells of a full lattice: ``level, row, col, share, across, is_index``.

    A crossing lies ``share`` of the way from the cell to its right (``across``) or lower neighbour.
    """
    right, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    sides = cells.withColumns({"e": F.lead("value").over(right), "s": F.lead("value").over(down)})
    pairs = sides.select("row", "col", "value", F.explode(F.array(F.struct(F.col("e").alias("other"), F.lit(True).alias("across")), F.struct(F.col("s").alias("other"), F.lit(False).alias("across")))).alias("p")).select("row", "col", "value", "p.*").filter("value is not null and other is not null and value <> other")
    low = F.floor((F.least("value", "other") - base) / interval) + 1
    high = F.ceil((F.greatest("value", "other") - base) / interval) - 1
    steps = pairs.withColumns({"k1": low, "k2": high}).filter("k1 <= k2").withColumn("k", F.explode(F.sequence("k1", "k2")))
    level = base + F.col("k") * interval
    return steps.select(level.alias("level"), "row", "col", ((level - F.col("value")) / (F.col("other") - F.col("value"))).alias("share"), "across", (F.col("k") % index_every == 0).alias("is_index"))


def contour_segments(cells: DataFrame, interval: float, base: float = 0.0) -> DataFrame:
    """Contour lines as segments, one for each crossing of a square of four cells: ``level, row, col, x1, y1, x2, y2, u, v, onward``.

    ``cells`` is a full lattice; ``x`` counts columns and ``y`` rows from the first centre. ``u`` and ``v`` name the lattice edges that
    a segment ends on, so segments of one line share them. ``onward`` says that the way from 1 to 2 has the higher ground on its
    left as the map shows it; else the way back has. In a saddle the mean of the four corners says which sides join.
    Squares with a void have no line.
    """
    right, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    east = cells.select("row", "col", F.col("value").alias("a"), F.lead("value").over(right).alias("b"))
    square = east.withColumns({"d": F.lead("a").over(down), "c": F.lead("b").over(down)}).dropna(subset=["a", "b", "c", "d"])
    low = F.floor((F.least("a", "b", "c", "d") - base) / interval).cast("long")
    high = F.floor((F.greatest("a", "b", "c", "d") - base) / interval).cast("long")
    levels = square.withColumns({"k1": low + 1, "k2": high}).filter("k1 <= k2").withColumn("k", F.explode(F.sequence("k1", "k2")))
    levels = levels.withColumn("level", base + F.col("k") * interval)
    a, b, c, d = (F.col(n) for n in "abcd")
    level, x, y = F.col("level"), F.col("col").cast("double"), F.col("row").cast("double")
    over = {n: F.col(n) >= level for n in "abcd"}
    fits = F.col("row").between(0, (1 << 23) - 2) & F.col("col").between(0, (1 << 22) - 2) & F.col("k").between(-(1 << 15), (1 << 16) + (1 << 15) - 1)
    number = F.when(fits, F.col("k")).otherwise(F.raise_error(F.lit("contour_segments: rows to 8,388,606, columns to 4,194,302 and level numbers -32,768 to 98,303 have names of their own")))

    def name(row, col, side):
        return F.shiftleft(number.cast("long") + (1 << 15), 46).bitwiseOR(F.shiftleft(row.cast("long"), 23)).bitwiseOR(F.shiftleft(col.cast("long"), 1)).bitwiseOR(F.lit(side))

    share = lambda p, q: (level - p) / (q - p)
    sides = {
        "top": (over["a"] != over["b"], x + share(a, b), y, name(F.col("row"), F.col("col"), 0)),
        "right": (over["b"] != over["c"], x + 1, y + share(b, c), name(F.col("row"), F.col("col") + 1, 1)),
        "bottom": (over["d"] != over["c"], x + share(d, c), y + 1, name(F.col("row") + 1, F.col("col"), 0)),
        "left": (over["a"] != over["d"], x, y + share(a, d), name(F.col("row"), F.col("col"), 1)),
    }
    leaves = {"top": over["a"], "right": over["b"], "bottom": over["c"], "left": over["d"]}  # going around, from higher ground to lower
    ends = {n: F.when(on, F.struct(px.alias("x"), py.alias("y"), e.alias("e"), leaves[n].alias("out"))) for n, (on, px, py, e) in sides.items()}
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    met = F.array_compact(F.array(*ends.values()))
    joined = ((a + b + c + d) / 4 >= level) == over["a"]  # the first corner's side runs through the middle
    saddle = F.when(joined, F.array(pair(ends["top"], ends["right"]), pair(ends["bottom"], ends["left"]))).otherwise(F.array(pair(ends["top"], ends["left"]), pair(ends["right"], ends["bottom"])))
    lines = levels.withColumn("met", met).withColumn("s", F.explode(F.when(F.size("met") == 4, saddle).otherwise(F.array(pair(F.get("met", F.lit(0)), F.get("met", F.lit(1)))))))
    p, q = F.col("s.p"), F.col("s.q")
    return lines.select("level", "row", "col", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), p["e"].alias("u"), q["e"].alias("v"), (~p["out"]).alias("onward"))


def contour_lines(cells: DataFrame, interval: float, base: float = 0.0, tolerance: float = 0.7, index_every: int = 5, least: int = 4) -> DataFrame:
    """Contour lines as ordered vertices: ``level, line, seq, x, y, closed, is_index``; higher ground is on their left as the map shows it.

    Segments are chained and thinned by ``tolerance`` cells (0 keeps all vertices); rings of under ``least`` vertices left are
    dropped. ``x`` counts columns and ``y`` rows from the first centre; a ring ends where it began.
    """
    s = materialise(contour_segments(cells, interval, base), "contour-segments")
    turned = F.when(F.col("onward"), F.struct("u", "v", "x1", "y1", "x2", "y2")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    lines = materialise(chained(s.select(turned.alias("t")).select("t.*")), "contour-chains")
    thin = simplified(lines, tolerance) if tolerance > 0 else lines
    thin = materialise(thin, "contour-thin")
    sizes = thin.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("closed").alias("ring"))
    good = sizes.filter(~F.col("ring") | (F.col("n") > least)).select("line")
    k = F.shiftright("line", 46) - (1 << 15)
    return thin.join(good, "line", "left_semi").select((base + k * interval).alias("level"), "line", "seq", "x", "y", "closed", (k % index_every == 0).alias("is_index"))


def contour_features(lines: DataFrame, grid: Grid) -> DataFrame:
    """One GeoJSON feature a line of ``contour_lines``: ``line, feature``, with ``elevation`` and ``index`` as properties and map coordinates."""
    at = F.array(grid.centre_x(F.col("x")), grid.centre_y(F.col("y")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", at.alias("at")))), lambda p: p["at"])
    rows = lines.groupBy("level", "line", "is_index").agg(ordered.alias("coordinates"))
    shape = F.struct(F.lit("LineString").alias("type"), "coordinates")
    about = F.struct(F.round("level", 4).alias("elevation"), F.col("is_index").alias("index"))
    return rows.select("line", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), about.alias("properties"))).alias("feature"))


def contour_rings(segments: DataFrame) -> DataFrame:
    """Lines of ``contour_segments``: ``level, ring, segments, length, closed``.

    Segments that share an end are one line, found as connected components, so a line may run through any number of
    tasks. It is closed if each of its ends has two segments.
    """
    from ..operators.graph import components

    lines = materialise(segments, "segments")
    roots = materialise(components(lines.select("u", "v")), "rings")
    degree = lines.select(F.col("u").alias("node")).unionByName(lines.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    loose = degree.join(roots, "node").groupBy("root").agg(F.count_if(F.col("n") != 2).alias("loose"))
    long = lines.join(roots, lines["u"] == roots["node"]).groupBy("level", "root").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))).alias("length"))
    return long.join(loose, "root").select("level", F.col("root").alias("ring"), "segments", "length", (F.col("loose") == 0).alias("closed"))


def depth_buffer(points: DataFrame, size: float) -> DataFrame:
    """Least depth in each buffer pixel, and with it which points are hidden: ``row, col, depth``."""
    return points.groupBy(F.floor(F.col("v") / size).cast("int").alias("row"), F.floor(F.col("u") / size).cast("int").alias("col")).agg(F.min("depth").alias("depth"))


def despeckle(cells: DataFrame, least: int) -> DataFrame:
    """The cells of patches of at least so many cells."""
    from ..operators.graph import raster_patches

    kept = raster_patches(cells).filter(F.col("cells") >= least).select("row", "col")
    return cells.join(kept, ["row", "col"], "left_semi")


def shared_cells(layers: DataFrame, least: int = 50) -> DataFrame:
    """Mean and deviation of each two layers (``layer, row, col, value``) over the cells both have."""
    a, b = (layers.select("row", "col", F.col("layer").alias(s), F.col("value").alias(f"v{s}")) for s in "ij")
    met = a.join(b, ["row", "col"]).filter("i < j")
    return met.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("vi").alias("mean_i"), F.avg("vj").alias("mean_j"), F.stddev_pop("vi").alias("std_i"), F.stddev_pop("vj").alias("std_j")).filter(F.col("n") >= least)


def dilated(cells: DataFrame, radius: int) -> DataFrame:
    """Cells within ``radius`` of a filled one."""
    return halo(cells.filter("value is not null"), disk(radius)).select("row", "col").distinct()
