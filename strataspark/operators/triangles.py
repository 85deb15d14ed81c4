"""Triangulated surfaces over clouds of any size: tiles that look as far as they must, so that their union is the one global mesh."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package
from .delaunay import Mesh, circles, hull
from .grid import Grid

MOST_POINTS = 4_000  # points of the fullest tile, where the tile's side is chosen here
LAYER = "layer"
BOX = ["west", "south", "east", "north"]
CORNERS = [f"{a}{k}" for k in "abc" for a in "xyz"]
REPLY = "kind string, layer int, tx long, ty long, " + ", ".join(f"{c} double" for c in BOX + CORNERS) + ", row int, col int, value double"


def distinct_points(points: DataFrame) -> DataFrame:
    """``layer, x, y, z``: of points at one place the highest; without a layer column all are in layer 0. Points without a place or height are left out."""
    layer = F.col(LAYER).cast("int") if LAYER in points.columns else F.lit(0)
    rows = points.select(layer.alias(LAYER), *[(F.col(c) + F.lit(0.0)).cast("double").alias(c) for c in "xyz"]).dropna()
    return rows.groupBy(LAYER, "x", "y").agg(F.max("z").alias("z"))


def tile_side(points: DataFrame, most: int = MOST_POINTS) -> float:
    """A side at which no tile holds more than ``most`` of the distinct points: halved until the fullest is small enough."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).head()
    if not b[4]:
        return 1.0
    side = max(b[1] - b[0], b[3] - b[2], 1e-9) * 1.0000001
    while True:
        full = points.groupBy(LAYER, F.floor(F.col("x") / side), F.floor(F.col("y") / side)).count().agg(F.max("count")).head()[0]
        if full <= most:
            return side
        side /= 2 if full <= 16 * most else 4


def _hulls(points: DataFrame) -> DataFrame:
    """Corners of each layer's convex hull: hulls of batches, of salted groups of them, then of the rest."""

    def of(table: pa.Table) -> pa.Table:
        layer, x, y, z = (table.column(c).to_numpy() for c in (LAYER, "x", "y", "z"))
        keep = [np.flatnonzero(layer == k)[hull(x[layer == k], y[layer == k])] for k in np.unique(layer)]
        return table.take(pa.array(np.concatenate([*keep, np.zeros(0, np.int64)])))

    def batches(some):
        for b in some:
            yield from of(pa.Table.from_batches([b])).to_batches()

    ddl = "layer int, x double, y double, z double"
    rows = points.select(LAYER, "x", "y", "z").mapInArrow(batches, ddl)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(32))).groupBy(LAYER, "salt").applyInArrow(lambda t: of(t.drop(["salt"])), ddl)
    return salted.groupBy(LAYER).applyInArrow(of, ddl)


def _kernel(side: float, emit):
    """One tile: triangulate what it sees, hand on its triangles if all that touch it are sure, else ask to see more."""

    def run(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1).to_pylist()[0]
        layer, tx, ty = head[LAYER], head["tx"], head["ty"]
        seen = np.array([head[c] for c in BOX])
        world = np.array([head[f"w_{c}"] for c in BOX])
        x, y, z = (table.column(c).to_numpy() for c in "xyz")
        _, one = np.unique(np.stack([x, y], 1), axis=0, return_index=True)  # a corner of the hull may lie in the box too
        x, y, z = x[one], y[one], z[one]
        core = np.array([tx, ty, tx + 1, ty + 1], float) * side
        t = Mesh(x, y).triangles()
        if len(t):
            low, high = np.minimum.reduce([x[t[:, k]] for k in range(3)]), np.maximum.reduce([x[t[:, k]] for k in range(3)])
            near = (low <= core[2]) & (high >= core[0])
            low, high = np.minimum.reduce([y[t[:, k]] for k in range(3)]), np.maximum.reduce([y[t[:, k]] for k in range(3)])
            t = t[near & (low <= core[3]) & (high >= core[1])]
            t = t[_touches(x, y, t, core)]
        if len(t):
            needs = _reach(x, y, t, world)
            short = (needs[:, :2] < np.maximum(seen[:2], world[:2])).any(1) | (needs[:, 2:] > np.minimum(seen[2:], world[2:])).any(1)
            if short.any():
                wanted = np.concatenate([needs[short, :2].min(0), needs[short, 2:].max(0)])
                grown = 2 * side + np.concatenate([core[:2] - seen[:2], seen[2:] - core[2:]])  # each side at most doubles
                wanted = np.concatenate([np.maximum(wanted[:2], seen[:2] - grown[:2]), np.minimum(wanted[2:], seen[2:] + grown[2:])])
                wanted = np.concatenate([np.minimum(wanted[:2], seen[:2]), np.maximum(wanted[2:], seen[2:])])
                return _reply("open", layer, tx, ty, dict(zip(BOX, ([v] for v in wanted), strict=True)), 1)
        return emit(layer, tx, ty, core, x, y, z, t)

    return run


def _reply(kind, layer, tx, ty, columns: dict, n: int) -> pa.Table:
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in REPLY.split(", ")])
    fixed = {"kind": [kind] * n, LAYER: [layer] * n, "tx": [tx] * n, "ty": [ty] * n}
    return pa.table([pa.array((fixed | columns).get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _touches(x, y, t, box) -> np.ndarray:
    """Which triangles (whose bounds meet the box) are not wholly beyond one of their own edges as seen from the box."""
    on = np.ones(len(t), bool)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        ax, ay, bx, by = x[t[:, i]], y[t[:, i]], x[t[:, j]], y[t[:, j]]
        side = np.stack([(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (box[0], box[2]) for cy in (box[1], box[3])])
        on &= side.max(0) >= 0
    return on


def _reach(x, y, t, world) -> np.ndarray:
    """Bounds of that part of each circle that lies in the bounds of all points; a little wider than rounding may make it."""
    cx, cy, r = circles(x, y, t)
    r = r * (1 + 1e-9)
    odd = ~np.isfinite(r)
    down = np.maximum(np.maximum(world[1] - cy, cy - world[3]), 0)
    across = np.maximum(np.maximum(world[0] - cx, cx - world[2]), 0)
    wide, high = np.sqrt(np.maximum(r * r - down * down, 0)), np.sqrt(np.maximum(r * r - across * across, 0))
    out = np.stack([np.maximum(cx - wide, world[0]), np.maximum(cy - high, world[1]), np.minimum(cx + wide, world[2]), np.minimum(cy + high, world[3])], 1)
    out[odd] = world
    return out


def _triangles(layer, tx, ty, core, x, y, z, t):
    """Triangles whose first corner in order of (x, y) lies in the tile: each of the mesh comes from one tile."""
    corners = np.stack([x[t], y[t]], 2) if len(t) else np.zeros((0, 3, 2))
    first = np.lexsort((corners[:, :, 1].T, corners[:, :, 0].T), axis=0)[0] if len(t) else np.zeros(0, np.int64)
    lead = corners[np.arange(len(t)), first]
    own = (lead[:, 0] >= core[0]) & (lead[:, 0] < core[2]) & (lead[:, 1] >= core[1]) & (lead[:, 1] < core[3])
    t, first = t[own], first[own]
    turned = np.stack([t[np.arange(len(t)), (first + k) % 3] for k in range(3)], 1) if len(t) else t
    columns = {f"{a}{c}": v[turned[:, k]] for k, c in enumerate("abc") for a, v in zip("xyz", (x, y, z), strict=True)}
    return _reply("triangle", layer, tx, ty, columns, len(t))


def _cells(grid: Grid, max_edge: float | None, free_layers: tuple[int, ...]):
    """Heights at the centres of the cells in the tile, on the planes of its triangles; long ones give none."""

    def emit(layer, tx, ty, core, x, y, z, t):
        keep = np.ones(len(t), bool)
        if max_edge is not None and layer not in free_layers and len(t):
            keep = np.max([np.hypot(x[t[:, i]] - x[t[:, j]], y[t[:, i]] - y[t[:, j]]) for i, j in ((0, 1), (1, 2), (2, 0))], 0) <= max_edge
        found: dict[tuple[int, int], float] = {}
        for a, b, c in t[keep].tolist():
            c0 = max(0, int(np.floor((max(min(x[a], x[b], x[c]), core[0]) - grid.west) / grid.cell_x - 0.5)))
            c1 = min(grid.cols - 1, int(np.ceil((min(max(x[a], x[b], x[c]), core[2]) - grid.west) / grid.cell_x - 0.5)))
            r0 = max(0, int(np.floor((grid.north - min(max(y[a], y[b], y[c]), core[3])) / grid.cell_y - 0.5)))
            r1 = min(grid.rows - 1, int(np.ceil((grid.north - max(min(y[a], y[b], y[c]), core[1])) / grid.cell_y - 0.5)))
            if c1 < c0 or r1 < r0:
                continue
            rows, cols = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
            px, py = grid.west + (cols + 0.5) * grid.cell_x, grid.north - (rows + 0.5) * grid.cell_y
            d = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
            wb = ((px - x[a]) * (y[c] - y[a]) - (py - y[a]) * (x[c] - x[a])) / d
            wc = ((x[b] - x[a]) * (py - y[a]) - (y[b] - y[a]) * (px - x[a])) / d
            inside = (wb >= -1e-12) & (wc >= -1e-12) & (wb + wc <= 1 + 1e-12) & (px >= core[0]) & (px < core[2]) & (py >= core[1]) & (py < core[3])
            height = z[a] + wb * (z[b] - z[a]) + wc * (z[c] - z[a])
            for r, k, h in zip(rows[inside].tolist(), cols[inside].tolist(), height[inside].tolist(), strict=True):
                found[r, k] = max(h, found.get((r, k), h))
        return _reply("cell", layer, tx, ty, {"row": [k[0] for k in found], "col": [k[1] for k in found], "value": list(found.values())}, len(found))

    return emit


def _meshed(points: DataFrame, side: float, tiles: DataFrame, emit) -> DataFrame:
    """Replies of all ``tiles`` (``layer, tx, ty``) over distinct ``points``: rounds in which the tiles that are not sure yet see more."""
    spark = points.sparkSession
    ship_package(spark)
    home = materialise(points.withColumns({"hx": F.floor(F.col("x") / side), "hy": F.floor(F.col("y") / side)}), "tin-points")
    corners = materialise(_hulls(home), "tin-hulls")
    world = home.groupBy(LAYER).agg(F.min("x").alias("w_west"), F.min("y").alias("w_south"), F.max("x").alias("w_east"), F.max("y").alias("w_north"))
    edge = {"west": F.col("tx") - 1, "south": F.col("ty") - 1, "east": F.col("tx") + 2, "north": F.col("ty") + 2}
    asked = tiles.join(world, LAYER).withColumns({k: v * F.lit(side) for k, v in edge.items()})
    columns = [LAYER, "tx", "ty", *BOX, *[f"w_{c}" for c in BOX]]
    asked, done = materialise(asked.select(*columns), "tin-asked"), None
    while not asked.isEmpty():
        span = lambda low, high, least, most: F.sequence(F.greatest(F.floor(F.col(low) / side), F.floor(F.col(least) / side)), F.least(F.floor(F.col(high) / side), F.floor(F.col(most) / side)))
        meets = (F.col("west") <= F.col("w_east")) & (F.col("east") >= F.col("w_west")) & (F.col("south") <= F.col("w_north")) & (F.col("north") >= F.col("w_south"))
        dealt = asked.filter(meets).withColumn("hx", F.explode(span("west", "east", "w_west", "w_east"))).withColumn("hy", F.explode(span("south", "north", "w_south", "w_north")))
        inside = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
        seen = dealt.join(home, [LAYER, "hx", "hy"]).filter(inside).select(*columns, "x", "y", "z")
        both = seen.unionByName(asked.join(corners, LAYER).select(*columns, "x", "y", "z"))
        replies = materialise(both.groupBy(LAYER, "tx", "ty").applyInArrow(_kernel(side, emit), REPLY), "tin-replies")
        sure = replies.filter("kind <> 'open'")
        done = sure if done is None else done.unionByName(sure)
        asked = materialise(replies.filter("kind = 'open'").join(world, LAYER).select(*columns), "tin-asked")
    return done if done is not None else spark.createDataFrame([], REPLY)


def delaunay(points: DataFrame, side: float | None = None) -> DataFrame:
    """Delaunay triangles of all points of each layer: ``layer, xa, ya, za, .., zc``, counter-clockwise from the first corner in order of (x, y).

    Tiles of ``side`` (chosen so that the fullest has ``MOST_POINTS``) triangulate what they and their neighbours hold, with the corners of
    the global hull. A triangle is sure when its circle lies in what the tile sees, as far as there are points at all; a tile that
    some unsure triangle touches looks further in that direction, up to twice as far each round. Sure triangles are those of the global mesh, and
    points on one circle are told apart by their places alone, so tiles agree. Of points at one place the highest counts;
    fewer than three points or points in line have no triangle.
    """
    own = materialise(distinct_points(points), "tin-distinct")
    side = side or tile_side(own)
    tiles = own.select(LAYER, F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty")).distinct()
    return _meshed(own, side, tiles, _triangles).select(LAYER, *CORNERS)


def tin_grid(points: DataFrame, grid: Grid, max_edge: float | None = None, side: float | None = None, free_layers: tuple[int, ...] = ()) -> DataFrame:
    """``layer, row, col, value``: the triangulated surface at the cell centres that lie in the hull, but for triangles with an edge over ``max_edge`` (in other layers than ``free_layers``)."""
    own = materialise(distinct_points(points), "tin-distinct")
    side = side or tile_side(own)
    b = own.groupBy(LAYER).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("z", F.max))])
    tile = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))
    tiles = b.withColumn("tx", tile("ax", "zx")).withColumn("ty", tile("ay", "zy")).select(LAYER, "tx", "ty")
    return _meshed(own, side, tiles, _cells(grid, max_edge, free_layers)).select(LAYER, "row", "col", "value")


def highest_per_half_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """The highest point of each half cell, ties by place: what a surface over the tops needs."""
    half = Grid(grid.west, grid.north, grid.cell_x / 2, grid.cell_y / 2, 2 * grid.cols, 2 * grid.rows)
    top = F.max(F.struct("z", "x", "y")).alias("p")
    return points.groupBy(half.row(F.col("y")).alias("r"), half.col(F.col("x")).alias("c")).agg(top).select("p.x", "p.y", "p.z")


def pit_free(points: DataFrame, grid: Grid, step: float = 2.5, max_edge: float | None = None, reach: int = 2, thresholds: list[float] | None = None, side: float | None = None) -> DataFrame:
    """Heights (``x, y, z`` over the ground) as a surface without pits: ``row, col, value``.

    The highest points of half cells are triangulated once whole and once for each height of a ladder (every ``step``, or ``thresholds``) from what
    stands that high, without triangles with an edge over ``max_edge`` (three cells if not given); each cell takes the highest. Cells
    over ``reach`` steps (to four sides) from any point are left out. All rungs run in one job, as layers.
    """
    tops = materialise(highest_per_half_cell(points, grid), "pit-free-tops")
    highest = tops.agg(F.max("z")).head()[0]
    if highest is None:
        return tops.sparkSession.createDataFrame([], "row int, col int, value double")
    ladder = thresholds if thresholds is not None else [k * step for k in range(1, int(highest / step) + 2)]
    rungs = [0.0, *sorted({float(t) for t in ladder if 0 < t < highest})]
    marks = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(t).alias("t")) for k, t in enumerate(rungs)])
    layered = tops.withColumn("m", F.explode(F.filter(marks, lambda m: (m["layer"] == 0) | (F.col("z") >= m["t"])))).select("m.layer", "x", "y", "z")
    edge = max_edge or 3 * max(grid.cell_x, grid.cell_y)
    surface = tin_grid(layered, grid, edge, side, (0,)).groupBy("row", "col").agg(F.max("value").alias("value"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if abs(a) + abs(b) <= reach])
    held = points.select(grid.row(F.col("y")).alias("r"), grid.col(F.col("x")).alias("c")).distinct().withColumn("s", F.explode(steps))
    near = held.select((F.col("r") + F.col("s.a")).alias("row"), (F.col("c") + F.col("s.b")).alias("col")).distinct()
    return surface.join(near, ["row", "col"], "left_semi")
