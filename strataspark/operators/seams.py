"""Seams of least difference: every layer grows from its core over ground on which the layers agree, and meets the others at the seam."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release, ship_package
from .quantiles import middle

TILE = 64
PENALTY = 8.0
DEEP = 0.8
MOST_ROUNDS = 10_000
_STATE = "layer long, row int, col int, cost double, dist double, changed boolean"


def disagreement(layers: DataFrame) -> DataFrame:
    """``row, col, covered, cost``: 1 where a cell has one layer, and more by how far its layers lie from their median, set against the usual."""
    cells = layers.filter("value is not null").groupBy("row", "col").agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("v"))  # as many values as layers cover the cell
    n = F.size("v")
    mid = (F.get("v", ((n - 1) / 2).cast("int")) + F.get("v", (n / 2).cast("int"))) / 2
    spread = F.aggregate(F.transform("v", lambda x: F.abs(x - F.col("m"))), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    found = cells.select("row", "col", "v", n.alias("n"), mid.alias("m")).select("row", "col", F.col("n").alias("covered"), F.when(F.col("n") > 1, spread).otherwise(0.0).alias("spread"))
    found = materialise(found, "seam-spread")
    usual = middle(found.filter("covered > 1"), "spread", name="usual").select(F.greatest(F.coalesce("usual", F.lit(1.0)), F.lit(1e-6)).alias("usual"))
    return found.crossJoin(F.broadcast(usual)).select("row", "col", "covered", (1 + PENALTY * F.col("spread") / F.col("usual")).alias("cost"))


def cores(layers: DataFrame, cells: DataFrame) -> DataFrame:
    """``layer, row, col, cost, core``: a layer's core is where it is alone, and what lies deep in it: at least ``DEEP`` of the greatest depth.

    The depth of a cell is its least way along row or column to the end of the layer's run of cells.
    """
    own = layers.filter("value is not null").select(F.col("layer").cast("long").alias("layer"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    across, down = Window.partitionBy("layer", "row").orderBy("col"), Window.partitionBy("layer", "col").orderBy("row")
    runs = own.withColumns({"h": F.col("col") - F.row_number().over(across), "w": F.col("row") - F.row_number().over(down)})
    h, w = Window.partitionBy("layer", "row", "h"), Window.partitionBy("layer", "col", "w")
    ends = [F.col("col") - F.min("col").over(h), F.max("col").over(h) - F.col("col"), F.col("row") - F.min("row").over(w), F.max("row").over(w) - F.col("row")]
    deep = materialise(runs.select("layer", "row", "col", (F.least(*ends) + 1).alias("depth")), "seam-depth")
    most = deep.groupBy("layer").agg(F.max("depth").alias("most"))
    met = deep.join(most, "layer").join(cells, ["row", "col"])
    return met.select("layer", "row", "col", "cost", ((F.col("covered") == 1) | (F.col("depth") >= DEEP * F.col("most"))).alias("core"))


def _relax(table: pa.Table) -> pa.Table:
    """Shortest ways in one tile of a layer, from what is known in it and just beyond its edges."""
    beyond = table.column("beyond").to_numpy(zero_copy_only=False)
    row, col, cost, dist = (table.column(c).to_numpy() for c in ("row", "col", "cost", "dist"))
    own = np.flatnonzero(~beyond)
    place = {(r, c): k for k, (r, c) in enumerate(zip(row[own].tolist(), col[own].tolist(), strict=True))}
    price, way = cost[own].tolist(), dist[own].copy()
    start, heap = way.copy(), []
    fresh = table.column("fresh").to_numpy(zero_copy_only=False)[own]
    heap = [(way[k], k) for k in np.flatnonzero(np.isfinite(way) & fresh).tolist()]
    for k in np.flatnonzero(beyond).tolist():
        r, c, d, p = int(row[k]), int(col[k]), float(dist[k]), float(cost[k])
        for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            at = place.get(near)
            if at is not None and d + 0.5 * (p + price[at]) < way[at]:
                way[at] = d + 0.5 * (p + price[at])
                heap.append((way[at], at))
    heapq.heapify(heap)
    rows, cols = row[own].tolist(), col[own].tolist()
    while heap:
        d, k = heapq.heappop(heap)
        if d > way[k]:
            continue
        r, c = rows[k], cols[k]
        for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            at = place.get(near)
            if at is not None and d + 0.5 * (price[k] + price[at]) < way[at]:
                way[at] = d + 0.5 * (price[k] + price[at])
                heapq.heappush(heap, (way[at], at))
    layer = table.column("layer").to_numpy()[own]
    changed = (way < start) | (fresh & np.isfinite(way))
    return pa.table([pa.array(layer), pa.array(row[own]), pa.array(col[own]), pa.array(cost[own]), pa.array(way), pa.array(changed)], names=[c.split()[0] for c in _STATE.split(", ")])


def distances(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """``layer, row, col, dist``: the cheapest way of each cell to a core of its layer, over 4-neighbours at the mean of their costs; null if there is none.

    Tiles find the ways inside them, hand the changed cells of their edges to their neighbours and go on until nothing
    changes, so ways may cross any number of tiles; only tiles that were handed something run again.
    """
    ship_package(nodes.sparkSession)
    inf = F.lit(float("inf"))
    place = [F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("row", "ti"), ("col", "tj"))]
    now = nodes.select("layer", "row", "col", "cost", F.when(F.col("core"), 0.0).otherwise(inf).alias("dist"))
    asked = now.select("*", *place, F.lit(False).alias("beyond"), F.lit(True).alias("fresh"))
    now = materialise(asked.groupBy("layer", "ti", "tj").applyInArrow(_relax, _STATE), "seam-ways")
    for _ in range(MOST_ROUNDS):
        edge = now.filter("changed").select("layer", "row", "col", "cost", "dist", *place)
        sides = F.array(*[F.struct((F.col("ti") + a).alias("a"), (F.col("tj") + b).alias("b"), on.alias("on")) for a, b, on in (
            (-1, 0, F.col("row") % tile == 0), (1, 0, F.col("row") % tile == tile - 1), (0, -1, F.col("col") % tile == 0), (0, 1, F.col("col") % tile == tile - 1),
        )])
        handed = edge.withColumn("s", F.explode(F.filter(sides, lambda s: s["on"]))).select("layer", "row", "col", "cost", "dist", F.col("s.a").alias("ti"), F.col("s.b").alias("tj"))
        handed = materialise(handed, "seam-handed")
        if handed.isEmpty():
            break
        tiles = handed.select("layer", "ti", "tj").distinct()
        held = now.select("layer", "row", "col", "cost", "dist", *place)
        again = held.join(tiles, ["layer", "ti", "tj"], "left_semi").select("layer", "row", "col", "cost", "dist", "ti", "tj", F.lit(False).alias("beyond"), F.lit(False).alias("fresh"))
        both = again.unionByName(handed.select("*", F.lit(True).alias("beyond"), F.lit(False).alias("fresh")))
        made = both.groupBy("layer", "ti", "tj").applyInArrow(_relax, _STATE)
        rest = held.join(tiles, ["layer", "ti", "tj"], "left_anti").select("layer", "row", "col", "cost", "dist", F.lit(False).alias("changed"))
        before, now = now, materialise(made.unionByName(rest), "seam-ways")
        release(before, handed)
    return now.select("layer", "row", "col", F.when(F.col("dist") < inf, F.col("dist")).alias("dist"))


def least_difference(layers: DataFrame, tile: int = TILE) -> DataFrame:
    """``row, col, layer, dist``: of each cell the layer that reaches it most cheaply (ties to the lesser layer); cells that no core reaches go to the lesser layer with dist null.

    ``layers`` has ``layer, row, col, value``; nulls are voids.
    """
    ways = distances(cores(layers, disagreement(layers)), tile)
    best = ways.groupBy("row", "col").agg(F.min(F.struct(F.coalesce("dist", F.lit(float("inf"))).alias("d"), "layer")).alias("b"))
    return best.select("row", "col", F.col("b.layer").alias("layer"), F.when(F.col("b.d") < float("inf"), F.col("b.d")).alias("dist"))


def seam_mosaic(layers: DataFrame, tile: int = TILE) -> DataFrame:
    """``row, col, layer, value``: the mosaic cut along the seams."""
    owner = least_difference(layers, tile).select("row", "col", "layer")
    return layers.select(F.col("layer").cast("long").alias("layer"), "row", "col", "value").join(owner, ["row", "col", "layer"]).select("row", "col", "layer", "value")
