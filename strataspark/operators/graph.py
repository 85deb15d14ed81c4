"""Connected components by alternating stars, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; ``edges`` has two long columns ``u, v``. The root is the least node.

    Each round hangs neighbours on the least node of their neighbourhood (large star, then
    small star) and is written to the shared folder. No neighbourhood is gathered: the minimum is
    an aggregate that is combined before the shuffle, and its way back is a join that adaptive execution can split.
    Self-links, nulls and repeated edges are dropped first.
    """
    now = materialise(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def tracks(matches: DataFrame, least: int = 2) -> DataFrame:
    """Tracks of features: components of ``matches`` (``photo_a, feature_a, photo_b, feature_b``), as ``track, photo, feature``.

    Components that hold two features of one photo, or fewer than ``least``, are dropped.
    """
    node = lambda s: F.shiftleft(F.col(f"photo_{s}").cast("long"), 32).bitwiseOR(F.col(f"feature_{s}").cast("long"))
    found = components(matches.select(node("a").alias("u"), node("b").alias("v")))
    rows = found.select(F.col("root").alias("track"), F.shiftright("node", 32).alias("photo"), F.col("node").bitwiseAND(F.lit((1 << 32) - 1)).alias("feature"))
    good = rows.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("photo").alias("photos")).filter((F.col("n") == F.col("photos")) & (F.col("n") >= least))
    return rows.join(good.select("track"), "track", "left_semi")


def raster_patches(cells: DataFrame) -> DataFrame:
    """4-connected patches of filled cells: ``row, col, patch`` and the patch's size."""
    key = F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("col").cast("long"))
    filled = cells.filter("value is not null").select(key.alias("id"), "row", "col")
    ids = filled.select("id")
    right = filled.select("id", (F.col("id") + 1).alias("other"))
    below = filled.select("id", (F.col("id") + (1 << 32)).alias("other"))
    links = right.unionByName(below).join(ids.withColumnRenamed("id", "other"), "other", "left_semi")
    roots = components(links.select(F.col("id").alias("u"), F.col("other").alias("v")))
    named = filled.join(roots, filled["id"] == roots["node"], "left").select("row", "col", F.coalesce("root", "id").alias("patch"))
    sizes = named.groupBy("patch").agg(F.count(F.lit(1)).alias("cells"))
    return named.join(sizes, "patch").select("row", "col", "patch", "cells")
