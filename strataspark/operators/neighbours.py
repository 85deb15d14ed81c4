"""Neighbour joins: radius and nearest-neighbour in space, shared-point pairs, feature matches."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import exchanges, materialise, release, ship_package

AXES = ("x", "y", "z")


def _boxes(df: DataFrame, axes, size: float) -> DataFrame:
    return df.withColumns({f"c_{a}": F.floor(F.col(a) / size) for a in axes})


def _candidates(queries: DataFrame, points: DataFrame, axes, size: float, key: str) -> DataFrame:
    """Pairs of a query and the points of its own and all adjoining boxes, with ``d2``: one equi-join on the box."""
    steps = F.array(*[F.struct(*[F.lit(s).alias(a) for a, s in zip(axes, t, strict=True)]) for t in itertools.product((-1, 0, 1), repeat=len(axes))])
    q = _boxes(queries, axes, size).select(F.col(key).alias("q"), *[F.col(a).alias(f"q_{a}") for a in axes], *[f"c_{a}" for a in axes], F.explode(steps).alias("s"))
    q = q.select("q", *[f"q_{a}" for a in axes], *[(F.col(f"c_{a}") + F.col(f"s.{a}")).alias(f"c_{a}") for a in axes])
    p = _boxes(points, axes, size).select(F.col(key).alias("p"), *[F.col(a).alias(f"p_{a}") for a in axes], *[f"c_{a}" for a in axes])
    d2 = sum(((F.col(f"q_{a}") - F.col(f"p_{a}")) * (F.col(f"q_{a}") - F.col(f"p_{a}")) for a in axes), F.lit(0.0))
    return q.join(p, [f"c_{a}" for a in axes]).filter("q <> p").withColumn("d2", d2)


def radius_count(points: DataFrame, radius: float, key: str = "index", axes=AXES) -> DataFrame:
    """``key, n``: points within ``radius`` of each, itself left out."""
    near = _candidates(points, points, axes, radius, key).filter(F.col("d2") <= radius * radius).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return points.select(key).join(near, points[key] == near["q"], "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


CROWD = 8  # candidates for each wanted neighbour that the fullest of the first boxes may hold


def _thinned(points: DataFrame, k: int, key: str, axes) -> DataFrame:
    """Of the points at one place the ``k + 1`` with the least keys: no other can be among the ``k`` nearest of any point."""
    order = Window.partitionBy(*axes).orderBy(key)
    return points.select(key, *axes).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k + 1).drop("__r")


def _first_size(pool: DataFrame, k: int, size: float, reach: float, axes) -> float:
    """``size``, halved until its fullest box holds some ``CROWD * (k + 1)`` points, or boxes near what doubles can tell apart."""
    least = reach * 1e-12
    while size > least:
        n = _boxes(pool, axes, size).groupBy(*[f"c_{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
        if n is None or n <= CROWD * (k + 1):
            break
        size /= 2
    return size


def nearest(points: DataFrame, k: int, size: float, key: str = "index", axes=AXES, queries: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest other points of each, exactly: ``q, p, distance, rank``; ties by ``p``.

    A box and those around it hold all neighbours nearer than the box is wide. Boxes begin as small as the densest place
    asks, so that work follows the number of points and not their density. Each round asks the points whose own box holds enough
    of them, and what has found its neighbours is done; the rest go another round with boxes twice as wide, until none is left or a box holds all.
    """
    left = (points if queries is None else queries).select(key, *axes)
    pool = materialise(_thinned(points, k, key, axes), "nearest-pool")
    extent = pool.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).head()
    if queries is not None:  # queries may lie outside the pool
        outer = pool.unionByName(left).agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).head()
        extent = {a: max(float(extent[a] or 0), float(outer[a] or 0)) for a in axes}
    reach = max([float(extent[a] or 0) for a in axes] + [size])
    size = _first_size(pool, k, size, reach, axes)
    order = Window.partitionBy("q").orderBy("d2", "p")
    done: list[DataFrame] = []
    while True:
        last = size >= reach
        asked = left
        if not last:
            cell = [f"c_{a}" for a in axes]
            full = _boxes(pool, axes, size).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 4 >= k).drop("n")
            asked = _boxes(left, axes, size).join(full, cell, "left_semi").drop(*cell)
        near = _candidates(asked, pool, axes, size, key)
        ranked = (near if last else near.filter(F.col("d2") <= (size * (1 - 1e-9)) ** 2)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = materialise(ranked.select("q", "p", F.sqrt("d2").alias("distance"), "rank"), "nearest")
        if last:
            done.append(found)
            break
        settled = found.filter(F.col("rank") == k).select("q")
        done.append(found.join(settled, "q", "left_semi"))
        left = materialise(left.join(settled, left[key] == settled["q"], "left_anti"), "nearest-left")
        if left.isEmpty():
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def statistical_noise(points: DataFrame, k: int, size: float, deviations: float = 2.5, key: str = "index") -> DataFrame:
    """``key, mean_distance, noise``: points whose mean distance to ``k`` neighbours is over the mean of all by so many deviations."""
    near = materialise(nearest(points, k, size, key).groupBy("q").agg(F.avg("distance").alias("mean_distance")), "noise")
    stats = near.agg((F.avg("mean_distance") + deviations * F.stddev_pop("mean_distance")).alias("limit"))
    return near.crossJoin(F.broadcast(stats)).select(F.col("q").alias(key), "mean_distance", (F.col("mean_distance") > F.col("limit")).alias("noise"))


def isolated_noise(points: DataFrame, radius: float, least: int = 3, key: str = "index") -> DataFrame:
    """``key, n, noise``: points with fewer than ``least`` others within ``radius``."""
    return radius_count(points, radius, key).withColumn("noise", F.col("n") < least)


def relabel(points: DataFrame, noise: DataFrame, low: Column, key: str = "index") -> DataFrame:
    """Points found to be noise become class 7 where ``low`` holds and 18 elsewhere; earlier noise keeps its class."""
    marked = points.join(noise.filter("noise").select(key).withColumn("__noise", F.lit(True)), key, "left")
    old = F.col("classification")
    new = F.when(old.isin(7, 18) | F.col("__noise").isNull(), old).when(low, 7).otherwise(18)
    return marked.withColumn("classification", new.cast("short")).drop("__noise")


PART_ROWS = 1_000_000  # rows or pairs that a task is dealt
ITEM_PARTS = 16  # tasks over which the pairs of an item are dealt


def _parts(rows: int) -> int:
    return rows // PART_ROWS + 1


def co_occurrence(seen: DataFrame, item: str, group: str, least: int = 1) -> DataFrame:
    """``a, b, shared``: pairs of items and the groups both are in. Groups are the points of a block, so small.

    The distinct rows are written first: both sides of the join are then plain exchanges, and a group that is large all the
    same is split over tasks. Counts are combined before the shuffle, and written. Rows and pairs are dealt to tasks as many as they ask for.
    """
    spark = seen.sparkSession
    with exchanges(spark, _parts(seen.count())):
        rows = materialise(seen.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct(), "co-occurrence")
        n = F.count(F.lit(1)).cast("double")
        made = int(rows.groupBy("g").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).head()[0] or 0)
    with exchanges(spark, _parts(made)):
        pairs = rows.select("g", F.col("i").alias("a")).join(rows.select("g", F.col("i").alias("b")), "g").filter("a < b")
        shared = materialise(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least), "co-occurrence-pairs")
    release(rows)
    return shared


def best_partners(pairs: DataFrame, score: Column, per_item: int = 2) -> DataFrame:
    """The best pairs of each item, each unordered pair once; ties by the other item.

    The pairs of an item are dealt to up to ``ITEM_PARTS`` tasks, whose best are ranked; so neither many pairs nor an item in many fill one.
    """
    scored = pairs.withColumn("score", score)
    both = scored.select("a", "b", "score").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "b"))
    with exchanges(pairs.sparkSession, _parts(2 * pairs.count())):
        first = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(ITEM_PARTS))).repartition("a", "s").withColumn("r", best("a", "s")).filter(F.col("r") <= per_item)
        top = first.withColumn("r", best("a")).filter(F.col("r") <= per_item)
        return materialise(top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct(), "best-partners")


def stereo_score(shared: Column, ratio: Column) -> Column:
    """Score of a stereo pair: shared points, weighed by how near the base is to 0.35 of the height."""
    return F.when(ratio.between(0.2, 0.67), shared * F.exp(-F.pow((ratio - 0.35) / 0.2, F.lit(2.0))))


def stereo_pairs(images: DataFrame, shared: DataFrame, height: float, per_photo: int = 2, least: int = 40) -> DataFrame:
    """Pairs for dense matching: base over height in range, enough shared points, the best few of each photo."""
    a, b = (images.select(F.col("image_id").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")) for s in "ab")
    with exchanges(images.sparkSession, _parts(shared.count())):
        pairs = shared.filter(F.col("shared") >= least).join(a, "a").join(b, "b")
        ratio = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) / height
        scored = materialise(pairs.withColumn("ratio", ratio).filter(F.col("ratio").between(0.2, 0.67)), "stereo-pairs")
    return best_partners(scored, stereo_score(F.col("shared"), F.col("ratio")), per_photo)


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q).cast("double") * (p - q).cast("double")), F.lit(0.0), lambda s, v: s + v)


MATCH_ROWS = 1024  # descriptors of one side whose distances to as many times ``MATCH_WIDE`` of the other are held at once
MATCH_WIDE = 4
MATCH_SHARE = 16_384  # descriptors of a side that a task holds; a larger block is dealt into shares, of which each two meet


def _exact(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Squared distances as the column form has them: differences in the type of the descriptors, squares summed in order."""
    d = (one - two).astype(float)
    return np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else np.zeros(len(d))


def _least_two(one: np.ndarray, two: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each row of ``one`` its two nearest rows of ``two`` in order of ``(distance, id)``: places (-1: none) and squared distances.

    ``two`` is in order of ``ids``. Products of matrices tell which rows can be among the two nearest; those are measured exactly.
    ``own`` are the ids of ``one`` where a row is not its own neighbour.
    """
    place, d2 = np.full((len(one), 2), -1), np.full((len(one), 2), np.inf)
    if not len(two):
        return place, d2
    first = np.unique(two, axis=0, return_index=True, return_inverse=True)
    group = first[2].reshape(-1)
    rank = np.arange(len(two)) - np.concatenate([[0], np.cumsum(np.bincount(group))])[:-1][group[np.argsort(group, kind="stable")]]
    keep = np.sort(np.argsort(group, kind="stable")[rank < 3])  # of equal rows the three least ids: one may be the row itself
    wide, a2, b2 = two[keep].astype(float), (one.astype(float) ** 2).sum(1), (two[keep].astype(float) ** 2).sum(1)
    slack = 1e-12 * (one.shape[1] + 8) * (a2.max() + b2.max())
    if one.dtype == np.float32:  # differences of the column form are rounded to single precision
        slack += 1e-6 * (a2.max() + b2.max())
    for s in range(0, len(one), MATCH_ROWS):
        part = one[s : s + MATCH_ROWS].astype(float)
        row, hit = [], []
        bound = np.full((len(part), 2), np.inf)
        for c in range(0, len(wide), MATCH_ROWS * MATCH_WIDE):
            far = a2[s : s + MATCH_ROWS, None] - 2 * part @ wide[c : c + MATCH_ROWS * MATCH_WIDE].T + b2[c : c + MATCH_ROWS * MATCH_WIDE]
            if own is not None:
                far[own[s : s + MATCH_ROWS, None] == ids[keep[c : c + MATCH_ROWS * MATCH_WIDE]]] = np.inf
            low = np.partition(far, 1, axis=1)[:, :2] if far.shape[1] > 1 else far
            bound = np.sort(np.concatenate([bound, low], 1), axis=1)[:, :2]
            r, h = np.nonzero((far <= bound[:, 1:] + 2 * slack) & np.isfinite(far))
            row.append(r)
            hit.append(h + c)
        row, hit = np.concatenate(row), np.concatenate(hit)
        order = np.lexsort((hit, row))
        row, hit = row[order], keep[hit[order]]
        exact = np.concatenate([_exact(one[s + row[k : k + 50_000]], two[hit[k : k + 50_000]]) for k in range(0, max(len(row), 1), 50_000)])
        order = np.lexsort((hit, exact, row))
        row, hit, exact = row[order], hit[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        for k in (0, 1):
            at = nth == k
            place[s + row[at], k], d2[s + row[at], k] = hit[at], exact[at]
    return place, d2


_BEST = "side int, id long, other long, d2 double"


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _best(same: bool):
    """Rows of ``_BEST`` of two shares: the two nearest right ones of each left descriptor, and the nearest left one of each right one."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        (a, one), (b, two) = (_side(table.filter(pa.array(side == k))) if (side == k).any() else (np.zeros(0, np.int64), np.zeros((0, 1), np.float32)) for k in (0, 1))
        out = []
        if len(a) and len(b):
            for k, (p, x, q, y) in enumerate([(a, one, b, two)] if same else [(a, one, b, two), (b, two, a, one)]):
                place, d2 = _least_two(x, y, q, p if same else None)
                for n in range(1 if same or k else 2):
                    at = place[:, n] >= 0
                    out.append((np.full(at.sum(), k, np.int32), p[at], q[place[at, n]], d2[at, n]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int32, np.int64, np.int64, float))]
        return pa.table(columns, names=["side", "id", "other", "d2"])

    return run


def _met(left: DataFrame, right: DataFrame, block: str, same: bool) -> DataFrame:
    """``_BEST`` of all pairs of shares of each block. A block is dealt by id into shares of some ``MATCH_SHARE`` rows a side."""
    ship_package(left.sparkSession)
    rows = [d.select(F.col(block).alias("block"), F.lit(k).alias("side"), F.col("id").cast("long").alias("id"), "vector").filter("vector is not null") for k, d in enumerate((left, right))]
    sizes = rows[0].unionByName(rows[1]).groupBy("block").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == k) / MATCH_SHARE)).cast("int").alias(f"n{k}") for k in (0, 1)])
    sizes = materialise(sizes, "match-shares")
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(f"n{k}"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"n{k}") - 1))
    one = rows[0].join(sizes, "block").withColumns({"i": own(0).cast("int"), "j": every(1)})
    two = rows[1].join(sizes, "block").withColumns({"j": own(1).cast("int"), "i": every(0)})
    names = ["block", "i", "j", "side", "id", "vector"]
    return one.select(names).unionByName(two.select(names)).groupBy("block", "i", "j").applyInArrow(_best(same), _BEST)


def nearest_vectors(rows: DataFrame, block: str = "block") -> DataFrame:
    """``q, p``: the nearest other descriptor of its block for each of ``id, vector``; ties by ``p``. A row alone in its block is left out."""
    return _met(rows, rows, block, True).groupBy(F.col("id").alias("q")).agg(F.min_by("other", F.struct("d2", "other")).alias("p"))


def ratio_match(left: DataFrame, right: DataFrame, ratio: float = 0.8, block: str = "block") -> DataFrame:
    """Mutual best matches of descriptors within a block that pass the ratio test: ``a, b, distance``; ties by id.

    ``left`` and ``right`` have ``id, vector`` and a block column; ids are whole numbers. A block is a photo pair: it is dealt into shares,
    of which each two meet in a task, as products of matrices in parts of bounded size; what each task finds best is combined.
    """
    kind = left.schema["id"].dataType.simpleString()
    found = materialise(_met(left, right, block, False), "matches")
    least = F.min(F.struct("d2", "other"))
    best = found.filter("side = 0").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, 2).alias("m"))
    back = found.filter("side = 1").groupBy("id").agg(least.alias("m")).select(F.col("id").alias("b"), F.col("m.other").alias("a"))
    first = best.select(F.col("id").alias("a"), F.col("m")[0]["other"].alias("b"), F.sqrt(F.col("m")[0]["d2"]).alias("distance"), F.sqrt(F.get("m", F.lit(1))["d2"]).alias("second"))
    good = first.join(back, ["a", "b"]).filter(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))
    return good.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "distance")


def overlap_area(a: str, b: str) -> Column:
    """Common area of two boxes given as structs ``west, south, east, north``."""
    wide = F.least(F.col(f"{a}.east"), F.col(f"{b}.east")) - F.greatest(F.col(f"{a}.west"), F.col(f"{b}.west"))
    high = F.least(F.col(f"{a}.north"), F.col(f"{b}.north")) - F.greatest(F.col(f"{a}.south"), F.col(f"{b}.south"))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def tile_halo(points: DataFrame, tile: float, margin: float) -> DataFrame:
    """Each point in its own tile (``core``) and in every tile whose box, widened by the margin, holds it: ``tx, ty, core``."""
    steps = math.ceil(margin / tile)
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1)])
    home = points.withColumns({"hx": F.floor(F.col("x") / tile), "hy": F.floor(F.col("y") / tile)}).withColumn("s", F.explode(near))
    spread = home.withColumns({"tx": F.col("hx") + F.col("s.a"), "ty": F.col("hy") + F.col("s.b")})
    inside = (F.col("x") >= F.col("tx") * tile - margin) & (F.col("x") < (F.col("tx") + 1) * tile + margin) & (F.col("y") >= F.col("ty") * tile - margin) & (F.col("y") < (F.col("ty") + 1) * tile + margin)
    return spread.filter(inside).withColumn("core", (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy"))).drop("hx", "hy", "s")
