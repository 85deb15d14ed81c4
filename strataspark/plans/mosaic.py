"""Mosaics of overlapping layers ``layer, row, col, value``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.neighbours import overlap_area
from ..operators.quantiles import exact_quantiles
from ..session import materialise
from .terrain import shared_cells

QUANTILES = 101


def gains(layers: DataFrame, least: int = 50, offset: bool = False) -> dict:
    """Factor (and offset) of each layer that brings overlaps together: pair means in Spark, a sparse least-squares solve of the layers here.

    A pair of layers that overlap is one row (there are some for each layer, however many layers there are), and the normals are
    applied pair by pair, by conjugate gradients, so no matrix of all layers is made.
    """
    names = [r["layer"] for r in layers.select("layer").distinct().orderBy("layer").collect()]
    place, n = {k: i for i, k in enumerate(names)}, len(names)
    pairs = shared_cells(layers, least).collect()
    i, j = (np.array([place[r[k]] for r in pairs], np.int64) for k in "ij")
    count, mi, mj, si, sj = (np.array([r[k] or 0.0 for r in pairs], float) for k in ("n", "mean_i", "mean_j", "std_i", "std_j"))
    firm = 100 * max(1.0, count.sum()) ** 0.5  # the mean gain is one, whatever the overlaps say
    root = np.sqrt(count)

    def forward(x):
        """What each condition says of ``x``: overlaps agree in mean (and in spread), gains have mean one, offsets mean zero (or are zero)."""
        g, o = x[:n], x[n:]
        parts = [root * (mi * g[i] - mj * g[j] + o[i] - o[j]), [firm * g.sum(), firm * o.sum()]]
        return np.concatenate([*parts, root * (si * g[i] - sj * g[j]) if offset else firm * o])

    def back(r):
        m, g, o = len(i), np.zeros(n), np.zeros(n)
        w = root * r[:m]
        np.add.at(g, i, mi * w), np.add.at(g, j, -mj * w)
        np.add.at(o, i, w), np.add.at(o, j, -w)
        if offset:
            w = root * r[m + 2 :]
            np.add.at(g, i, si * w), np.add.at(g, j, -sj * w)
        else:
            o += firm * r[m + 2 :]
        return np.concatenate([g + firm * r[m], o + firm * r[m + 1]])

    right = np.zeros(len(i) + 2 + (len(i) if offset else n))
    right[len(i)] = firm * n
    x = _least_squares(forward, back, right, np.concatenate([np.ones(n), np.zeros(n)]))
    return {k: (float(x[p]), float(x[n + p])) for k, p in place.items()}


def _least_squares(forward, back, right: np.ndarray, start: np.ndarray, most: int = 20_000) -> np.ndarray:
    """The least-squares solution nearest to ``start``, by conjugate gradients on the normals."""
    x, r = start.copy(), right - forward(start)
    s = back(r)
    p, gamma = s.copy(), float(s @ s)
    goal = max(gamma, float(back(right) @ back(right))) * 1e-28
    for _ in range(most):
        if gamma <= goal:
            break
        q = forward(p)
        step = gamma / max(float(q @ q), 1e-300)
        x, r = x + step * p, r - step * q
        s = back(r)
        gamma, before = float(s @ s), gamma
        p = s + gamma / before * p
    return x


def quantile_match(layer: DataFrame, reference: DataFrame, least: int = 200) -> DataFrame:
    """Values of ``layer`` mapped so that its quantiles over the shared cells are those of ``reference``; unchanged if they share too few."""
    shares = [k / (QUANTILES - 1) for k in range(QUANTILES)]
    both = layer.select("row", "col", F.col("value").alias("a")).join(reference.select("row", "col", F.col("value").alias("b")), ["row", "col"])
    both = materialise(both.filter("a is not null and b is not null"), "shared-values")
    a, b = (exact_quantiles(both, c, shares).head() for c in "ab")  # 101 numbers a side
    if (a["n"] or 0) < least:
        return layer
    row = {"a": a["q"], "b": b["q"]}
    source = np.maximum.accumulate(np.array(row["a"]) + np.arange(QUANTILES) * 1e-6).tolist()
    steps = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("a0", "a1", "b0", "b1"), s, strict=True)]) for s in zip(source, source[1:], row["b"], row["b"][1:], strict=False)])
    v = F.greatest(F.lit(source[0]), F.least(F.lit(source[-1]), F.col("value")))
    part = F.element_at(F.filter(steps, lambda s: (s["a0"] <= v) & ((v < s["a1"]) | (s["a1"] == F.lit(source[-1])))), 1)
    return layer.withColumn("__s", part).withColumn("value", F.col("__s.b0") + (v - F.col("__s.a0")) / (F.col("__s.a1") - F.col("__s.a0")) * (F.col("__s.b1") - F.col("__s.b0"))).drop("__s")


def blend(layers: DataFrame, how: str = "order", sharpness: float = 20.0, order: dict | None = None) -> DataFrame:
    """One value a cell: ``order`` takes the first layer, ``nearest_center`` weighs by closeness to the middle of a layer, ``depth`` by its ``depth`` column."""
    rank = F.col("layer") if order is None else F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("layer"))
    if how == "order":
        return layers.groupBy("row", "col").agg(F.min_by("value", rank).alias("value"))
    if how == "nearest_center":
        middle = layers.groupBy("layer").agg(F.avg("row").alias("r"), F.avg("col").alias("c"))
        away = F.hypot(F.col("row") - F.col("r"), F.col("col") - F.col("c"))
        depth = layers.join(F.broadcast(middle), "layer").withColumn("depth", 1000.0 / (1.0 + away))
    else:
        depth = layers
    best = depth.withColumn("best", F.max("depth").over(Window.partitionBy("row", "col")))
    weight = F.exp((F.col("depth") - F.col("best")) / max(sharpness, 1e-3))
    return best.groupBy("row", "col").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))


def ordered_by_distance(frames: DataFrame, start: str | None = None) -> DataFrame:
    """Layers (``layer, west, south, east, north``) by distance from a first one, or from the middle of all."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    own = frames.withColumns({"cx": x, "cy": y})
    middle = own.filter(F.col("layer") == start).select(F.col("cx").alias("mx"), F.col("cy").alias("my")) if start else own.agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    return own.crossJoin(F.broadcast(middle)).withColumn("away", F.hypot(F.col("cx") - F.col("mx"), F.col("cy") - F.col("my"))).drop("mx", "my", "cx", "cy").orderBy("away", "layer")


MEET = 1_000  # frames of a cell that one share of it holds
MEETINGS = 20_000_000  # pairs of frames of one cell that a task looks at


def overlaps(frames: DataFrame) -> DataFrame:
    """Common area of each two frames that meet.

    Frames are filed under the cells they touch, cells being as large as the largest frame (so at most four each), and
    meet in an equi-join; a pair counts in the cell of its common corner only. A cell with many frames is dealt into shares of
    some ``MEET``, each of which meets them all in a task of its own: pairs are as many as the answer has, but no cell is one task's.
    """
    size = frames.agg(F.greatest(F.max(F.col("east") - F.col("west")), F.max(F.col("north") - F.col("south"))).alias("s")).head()["s"] or 1.0
    cell = lambda c: F.floor(F.col(c) / float(size))
    filed = frames.withColumns({"__i": F.explode(F.sequence(cell("west"), cell("east")))}).withColumn("__j", F.explode(F.sequence(cell("south"), cell("north"))))
    filed = materialise(filed.select("__i", "__j", "layer", "west", "south", "east", "north"), "frames-filed")
    a, b = (filed.select("__i", "__j", F.col("layer").alias(f"{s}_layer"), F.struct("west", "south", "east", "north").alias(s)) for s in "ab")
    shares = filed.groupBy("__i", "__j").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("__n"), F.pow(F.count(F.lit(1)), F.lit(2.0)).alias("__pairs"))
    tasks = int((shares.agg(F.sum("__pairs")).head()[0] or 0) // MEETINGS)
    shares = shares.drop("__pairs")
    a = a.join(shares, ["__i", "__j"]).withColumn("__s", F.pmod(F.xxhash64("a_layer"), F.col("__n"))).drop("__n")
    b = b.join(shares, ["__i", "__j"]).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    cells = ["__i", "__j", "__s"]
    if tasks > int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = (d.repartition(tasks, *cells) for d in (a, b))
    met = a.join(b, cells).filter(F.col("a_layer") < F.col("b_layer"))
    corner = (F.floor(F.greatest("a.west", "b.west") / float(size)) == F.col("__i")) & (F.floor(F.greatest("a.south", "b.south") / float(size)) == F.col("__j"))
    return met.filter(corner).select("a_layer", "b_layer", overlap_area("a", "b").alias("area")).filter("area > 0")


def union_bounds(frames: DataFrame) -> DataFrame:
    return frames.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
