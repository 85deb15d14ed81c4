"""Lines of any length out of directed segments: order by pointer jumping, thinning by distance from the chord."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .graph import components

MOST_ROUNDS = 64
SECTION = 4_000  # vertices of a section that one task thins at once


def chained(segments: DataFrame) -> DataFrame:
    """Vertices of the lines that directed segments form: ``line, seq, x, y, closed`` from ``u, v, x1, y1, x2, y2``.

    Each end ``u`` starts at most one segment and each ``v`` ends one. A line is a component of the segments; a ring is cut
    before its least node. Places come from pointer jumping: every segment learns how many follow it, in as many
    rounds as the longest line's length has binary digits, and no pointer is the target of two others, so no key is hot.
    A ring's first vertex comes again as its last.
    """
    own = materialise(segments.select("u", "v", *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]), "chain-segments")
    roots = materialise(components(own), "chain-roots")
    start = own.select("u", "v").join(roots, own["u"] == roots["node"]).select("u", "v", "root")
    begins = own.select(F.col("u").alias("begin"))
    linked = materialise(start.join(begins, start["v"] == begins["begin"], "left"), "chain-links")
    rings = linked.groupBy("root").agg((F.count_if(F.col("begin").isNull()) == 0).alias("ring"))
    last = F.col("ring") & (F.col("v") == F.col("root"))  # a ring is cut where it comes back to its root
    now = linked.join(rings, "root").select("u", "root", F.when(~last, F.col("begin")).alias("next"), F.when(last | F.col("begin").isNull(), 0).otherwise(1).cast("long").alias("ahead"), "ring")
    now = materialise(now, "chain-jump")
    for _ in range(MOST_ROUNDS):
        if now.filter("next is not null").isEmpty():
            break
        target = now.select(F.col("u").alias("t"), F.col("next").alias("t_next"), F.col("ahead").alias("t_ahead"))
        jump = now.join(target, now["next"] == target["t"], "left")
        jumped = jump.select("u", "root", F.col("t_next").alias("next"), (F.col("ahead") + F.coalesce("t_ahead", F.lit(0))).alias("ahead"), "ring")
        before, now = now, materialise(jumped, "chain-jump")
        release(before)
    else:
        raise RuntimeError("a line does not end: its segments are not directed alike")
    line = now.groupBy("root").agg((F.max("ahead") + 1).alias("size"), F.max("ring").alias("closed"))
    placed = own.join(now.select("u", "root", "ahead"), "u").join(line, "root").withColumn("seq", F.col("size") - 1 - F.col("ahead"))
    ends = F.when(F.col("ahead") == 0, F.array(F.struct("seq", F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct((F.col("seq") + 1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y"))))
    vertices = placed.withColumn("p", F.explode(F.coalesce(ends, F.array(F.struct("seq", F.col("x1").alias("x"), F.col("y1").alias("y"))))))
    return vertices.select(F.col("root").alias("line"), "p.seq", "p.x", "p.y", "closed")


def kept_by_distance(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a section stay: its ends, and again and again the farthest from the chord if it is over ``tolerance`` away (the first of equals)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        away = _away(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b])
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _away(x, y, ax, ay, bx, by):
    length = np.hypot(bx - ax, by - ay)
    if length == 0:
        return np.hypot(x - ax, y - ay)
    return np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """The vertices of ``line, seq, x, y`` (and what else they have) that a line needs to stay within ``tolerance`` of itself, by Douglas and Peucker's rule.

    Sections of over ``SECTION`` vertices are split at their farthest vertex by an aggregate over all tasks; what is shorter is one
    group, so no line is too long. Ends stay; a ring is a line whose ends meet.
    """
    columns = vertices.columns
    own = materialise(vertices.select("line", "seq", "x", "y"), "thin-vertices")
    first = own.groupBy("line").agg(F.min("seq").alias("part"))
    now = materialise(own.join(first, "line"), "thin-parts")
    kept = None
    while True:
        # a section's last vertex is the next one's first; it is in both
        sizes = now.groupBy("line", "part").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.max("seq").alias("last"))
        long = materialise(sizes.filter(F.col("n") > SECTION), "thin-long")
        short = now.join(long.select("line", "part"), ["line", "part"], "left_anti")
        done = materialise(short.groupBy("line", "part").applyInPandas(_thin(tolerance), "line long, seq long"), "thin-kept")
        kept = done if kept is None else kept.unionByName(done)
        if long.isEmpty():
            break
        met = now.join(long, ["line", "part"])
        length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
        cross = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")))
        away = F.when(length == 0, F.hypot(F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y"))).otherwise(cross / length)
        inner = met.filter((F.col("seq") > F.col("part")) & (F.col("seq") < F.col("last"))).select("line", "part", "seq", away.alias("away"))
        far = inner.groupBy("line", "part").agg(F.max(F.struct("away", (-F.col("seq")).alias("s"))).alias("f")).select("line", "part", F.col("f.away").alias("away"), (-F.col("f.s")).alias("cut"))
        far = materialise(far, "thin-far")
        flat = far.filter(F.col("away") <= tolerance).join(long, ["line", "part"])
        ends = flat.select("line", F.explode(F.array("part", "last")).alias("seq"))
        kept = kept.unionByName(ends)
        split = now.join(far.filter(F.col("away") > tolerance), ["line", "part"])
        side = F.when(F.col("seq") < F.col("cut"), F.array("part")).when(F.col("seq") > F.col("cut"), F.array("cut")).otherwise(F.array("part", "cut"))
        now = materialise(split.withColumn("side", F.explode(side)).select("line", "seq", "x", "y", F.col("side").alias("part")), "thin-parts")
    return vertices.join(kept.distinct(), ["line", "seq"]).select(*columns)


def _thin(tolerance):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.loc[kept_by_distance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), tolerance), ["line", "seq"]]

    return run
