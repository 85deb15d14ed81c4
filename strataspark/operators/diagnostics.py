"""Checks and summaries of a block: readiness, depth bands, headings, precision, automatic control, certificates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import quaternion, rotation
from ..session import materialise, ship_package
from .neighbours import nearest
from .quantiles import middle
from .ranks import global_rank

# Labels of the point classes of the LAS format.
CLASS_NAMES = {
    0: "Never classified", 1: "Unclassified", 2: "Ground", 3: "Low vegetation", 4: "Medium vegetation", 5: "High vegetation", 6: "Building", 7: "Low noise",
    8: "Model key-point", 9: "Water", 10: "Rail", 11: "Road surface", 12: "Overlap", 13: "Wire guard", 14: "Wire conductor", 15: "Transmission tower",
    16: "Wire connector", 17: "Bridge deck", 18: "High noise",
}


def class_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("Class "), code))


def colour_ramp(share: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Red, green and blue of a share of 0..1 between the stops, linear, as a struct of whole numbers."""
    v = F.greatest(F.lit(stops[0][0]), F.least(F.lit(stops[-1][0]), share))

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (a, ca), (b, cb) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(v <= b, ca[k] + (v - a) / (b - a) * (cb[k] - ca[k])).otherwise(out)
        return F.floor(out + 0.5).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def depth_band(points: DataFrame, depth: str = "depth", low: float = 0.45, high: float = 2.2) -> DataFrame:
    """Points whose depth lies between shares of the median depth."""
    mid = middle(points, depth, name="__m").drop("n")
    return points.crossJoin(F.broadcast(mid)).filter((F.col(depth) > low * F.col("__m")) & (F.col(depth) < high * F.col("__m"))).drop("__m")


def subsample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """``most`` rows by the order of a hash of the key: the same rows for any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def every(rows: DataFrame, order: list[str], about: int) -> DataFrame:
    """About so many rows at an even stride of their order."""
    total = rows.count()
    step = max(1, total // max(1, about))
    return global_rank(rows, order, "__r").filter(F.col("__r") % step == 0).drop("__r")


def readiness(images: DataFrame, observations: DataFrame, control: DataFrame) -> DataFrame:
    """What keeps a block from being solved: ``level, code, n``. Blockers: photos with under three measurements, under three active control points."""
    seen = images.select("image_id").join(observations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left")
    photos = seen.agg(F.count_if(F.coalesce("n", F.lit(0)) < 3).alias("starved"), F.count_if(F.coalesce("n", F.lit(0)).between(3, 5)).alias("thin"))
    used = control.join(observations.select("point_id").distinct(), "point_id", "left_semi").agg(F.count_if(~F.col("is_check")).alias("control"), F.count_if("is_check").alias("checks"))
    both = photos.crossJoin(used)
    rules = F.array(
        F.when(F.col("starved") > 0, F.struct(F.lit("blocker").alias("level"), F.lit("starved_photos").alias("code"), F.col("starved").alias("n"))),
        F.when(F.col("control") < 3, F.struct(F.lit("blocker").alias("level"), F.lit("control").alias("code"), F.col("control").alias("n"))),
        F.when(F.col("thin") > 0, F.struct(F.lit("warning").alias("level"), F.lit("thin_photos").alias("code"), F.col("thin").alias("n"))),
        F.when(F.col("checks") == 0, F.struct(F.lit("warning").alias("level"), F.lit("no_checks").alias("code"), F.col("checks").alias("n"))),
    )
    return both.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def tie_summary(observations: DataFrame) -> DataFrame:
    """Tracks, those of three rays and more, and the mean number of rays."""
    n = observations.groupBy("point_id").agg(F.count_distinct("image_id").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("n") >= 3).alias("multi_ray"), F.avg("n").alias("mean_rays"), F.max("n").alias("most_rays"))


def headings(matches: DataFrame, positions: DataFrame, least: int = 12) -> DataFrame:
    """Heading of each photo from the shifts of its matches: ``image_id, kappa, pairs``.

    A pair's median image shift is set against the ground vector between the photos' centres; the turns are averaged
    as complex numbers weighed by the root of the matches. Photos without a pair take the heading of the nearest that has one.
    """
    m = matches.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("col_b") - F.col("col_a")).alias("dc"), F.median(F.col("row_b") - F.col("row_a")).alias("dr")).filter(F.col("n") >= least)
    p, q = (positions.select(F.col("image_id").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")) for s in "ab")
    ground = F.atan2(F.col("y_b") - F.col("y_a"), F.col("x_b") - F.col("x_a"))
    film = F.atan2(F.col("dr"), -F.col("dc"))  # what moves left and up in the image lies ahead to the right
    pairs = m.join(p, "a").join(q, "b").withColumns({"turn": ground - film, "w": F.sqrt("n")})
    both = pairs.select(F.col("a").alias("image_id"), "turn", "w").unionByName(pairs.select(F.col("b").alias("image_id"), "turn", "w"))
    own = both.groupBy("image_id").agg(F.atan2(F.sum(F.col("w") * F.sin("turn")), F.sum(F.col("w") * F.cos("turn"))).alias("kappa"), F.count(F.lit(1)).alias("pairs"))
    placed = positions.join(own, "image_id", "left")
    have = placed.filter("kappa is not null").select("image_id", "x", "y", "kappa")
    box = placed.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).head()
    size = max(box["w"] or 0.0, box["h"] or 0.0, 1.0) / max(1.0, math.sqrt(box["n"]))
    closest = nearest(have, 1, size, "image_id", ("x", "y"), placed.filter("kappa is null"))
    near = closest.join(have.select(F.col("image_id").alias("p"), F.col("kappa").alias("hk")), "p").select(F.col("q").alias("image_id"), "hk")
    return placed.join(near, "image_id", "left").select("image_id", F.coalesce("kappa", "hk").alias("kappa"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def accept_control(proposals: DataFrame, existing: DataFrame, radius: float = 1.5) -> DataFrame:
    """Proposals ``image_id, x, y, z`` joined to the automatic point within the radius that their photo has not seen yet, else new points.

    ``existing`` has ``point_id, x, y, image_id``. Returns the proposals with ``point_id`` (null: new); an equi-join on cells of the radius.
    Of the points at one place that the same photos have seen only the least can be the answer, and of equal proposals one is asked,
    so work follows the number of different places.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    places = existing.groupBy("point_id").agg(F.first("x").alias("ex"), F.first("y").alias("ey"), F.array_sort(F.collect_set("image_id")).alias("seen"))
    places = materialise(places.groupBy("ex", "ey", "seen").agg(F.min("point_id").alias("point_id")), "control-places")
    asked = materialise(proposals.select("image_id", "x", "y").distinct(), "control-asked")
    spread = asked.select("image_id", "x", "y", F.explode(steps).alias("s")).withColumns({"i": cell("x") + F.col("s.a"), "j": cell("y") + F.col("s.b")})
    met = spread.join(places.withColumns({"i": cell("ex"), "j": cell("ey")}), ["i", "j"])
    near = met.filter((F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) <= radius) & ~F.array_contains("seen", F.col("image_id")))
    best = near.groupBy(*[F.col(c).alias(f"__{c}") for c in ("image_id", "x", "y")]).agg(F.min("point_id").alias("point_id"))
    return proposals.join(best, (proposals["image_id"] == best["__image_id"]) & (proposals["x"] == best["__x"]) & (proposals["y"] == best["__y"]), "left").drop("__image_id", "__x", "__y")


def corner_uncertainty(exterior: np.ndarray, covariance: np.ndarray, focal: float, half_width: float, half_height: float, ground: float) -> float:
    """Greatest standard error of the ground places of the frame corners, from the covariance of an orientation."""
    from .fits import _matrix

    def place(v: np.ndarray, u: float, w: float) -> np.ndarray:
        d = _matrix(*v[3:]).T @ np.array([u, w, -focal])
        return v[:2] + (ground - v[2]) / d[2] * d[:2]

    worst = 0.0
    for u in (-half_width, half_width):
        for w in (-half_height, half_height):
            j = np.empty((2, 6))
            for k in range(6):
                h = 1e-5 * max(1.0, abs(exterior[k]))
                e = np.zeros(6)
                e[k] = h
                j[:, k] = (place(exterior + e, u, w) - place(exterior - e, u, w)) / (2 * h)
            worst = max(worst, math.sqrt(max(np.trace(j @ covariance @ j.T), 0.0)))
    return worst


def mirror_check(marks: DataFrame, opposite: dict[str, str], most: float = 1.0) -> DataFrame:
    """Pairs of opposite fiducial marks whose coordinates do not cancel: ``a, b, off`` in mm."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in opposite.items()])
    want = marks.sparkSession.range(1).select(F.inline(pairs))
    p, q = (marks.select(F.col("slot").alias(s), F.col("x_mm").alias(f"x{s}"), F.col("y_mm").alias(f"y{s}")) for s in "ab")
    off = F.hypot(F.col("xa") + F.col("xb"), F.col("ya") + F.col("yb"))
    return want.join(p, "a").join(q, "b").select("a", "b", off.alias("off")).filter(F.col("off") > most)


def distortion_verdict(rms_um: Column) -> Column:
    return F.when(rms_um < 0.5, "good").when(rms_um < 2, "check").otherwise("suspect")


def word_rows(words: DataFrame) -> DataFrame:
    """Words ``page, text, x0, y0, x1, y1`` as lines ``page, row, line``: a word opens a row if its centre is off the row's
    running centre by more than 0.55 of the page's median word height. A page is one group."""
    ship_package(words.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["c", "x0"], kind="stable")
        tolerance = 0.55 * float((pdf["y1"] - pdf["y0"]).median())
        rows: list[list] = []
        centre = None
        for w in pdf.itertuples():
            if centre is None or abs(w.c - centre) > tolerance:
                rows.append([])
            rows[-1].append(w)
            centre = sum(x.c for x in rows[-1]) / len(rows[-1])
        lines = [" ".join(str(x.text) for x in sorted(r, key=lambda x: x.x0)) for r in rows]
        return pd.DataFrame({"page": pdf["page"].iloc[0], "row": range(len(lines)), "line": lines})

    return words.groupBy("page").applyInPandas(one, "page int, row int, line string")


FIELDS = {
    "focal_mm": r"(?i)(?:calibrated focal length|focal length|principal distance)[^0-9−-]*([−-]?[0-9]+[.,][0-9]+)",
    "ppa_x_mm": r"(?i)principal point of autocollimation[^0-9−-]*([−-]?[0-9]+[.,][0-9]+)",
    "serial": r"(?i)(?:lens|camera)\s+(?:no|number|serial)\.?\s*:?\s*([A-Za-z0-9-]+)",
}


def certificate_fields(lines: DataFrame) -> DataFrame:
    """Fields of a calibration certificate by page: the first line that a rule reads, as text."""
    found = [F.min_by(F.when(F.regexp_extract("line", p, 1) != "", F.regexp_extract("line", p, 1)), F.when(F.regexp_extract("line", p, 1) != "", F.col("row"))).alias(n) for n, p in FIELDS.items()]
    return lines.groupBy("page").agg(*found)


def similarity_3d(points: DataFrame, scale: float, turn: list[list[float]], shift: list[float]) -> DataFrame:
    """Points ``x, y, z`` under a similarity."""
    old = [F.col(c) for c in "xyz"]
    new = {c: scale * (turn[k][0] * old[0] + turn[k][1] * old[1] + turn[k][2] * old[2]) + shift[k] for k, c in enumerate("xyz")}
    return points.withColumns(new)


def crop(points: DataFrame, box: tuple[float, float, float, float, float, float] | None) -> DataFrame:
    """Points inside a box ``x0, y0, z0, x1, y1, z1``; all of them without one."""
    if box is None:
        return points
    return points.filter(F.col("x").between(box[0], box[3]) & F.col("y").between(box[1], box[4]) & F.col("z").between(box[2], box[5]))


def colmap_images(images: DataFrame) -> DataFrame:
    """Lines of an ``images.txt``: id, quaternion and translation of the ground-to-camera turn (y down, z ahead), camera, name."""
    m = rotation(F.col("omega"), F.col("phi"), F.col("kappa"))
    r = [m[0], [-v for v in m[1]], [-v for v in m[2]]]
    c = [F.col("X0"), F.col("Y0"), F.col("Z0")]
    t = [-(row[0] * c[0] + row[1] * c[1] + row[2] * c[2]) for row in r]
    return images.select("image_id", F.concat_ws(" ", "image_id", *[F.format_string("%.12f", v) for v in (*quaternion(r), *t)], "camera_id", "name").alias("line"))


def jobs_listing(jobs: DataFrame, limit: int, active_only: bool = False) -> DataFrame:
    rows = jobs.filter(F.col("status").isin("queued", "running")) if active_only else jobs
    return rows.orderBy(F.desc("created"), "job_id").limit(limit)


def pixel_centres(observations: DataFrame, version: int) -> DataFrame:
    """Measurements of schemas before 4 had whole numbers at pixel corners: half a pixel off, by the overview's scale for automatic ones."""
    if version >= 4:
        return observations
    off = F.when(F.col("automatic"), (F.coalesce("scale", F.lit(1.0)) - 1) / 2).otherwise(-0.5)
    return observations.withColumns({"col": F.col("col") + off, "row": F.col("row") + off})


def save_snapshot(state: DataFrame, folder: str, ns: int) -> str:
    path = f"{folder}/snapshot={ns:020d}"
    state.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, ns: int | None = None) -> DataFrame:
    """The latest snapshot, or the latest at or before ``ns``; folders are found by partition discovery."""
    every_one = spark.read.parquet(folder).withColumn("snapshot", F.col("snapshot").cast("long"))
    kept = every_one if ns is None else every_one.filter(F.col("snapshot") <= ns)
    last = kept.agg(F.max("snapshot").alias("__last"))
    return kept.join(F.broadcast(last), F.col("snapshot") == F.col("__last")).drop("__last", "snapshot")
