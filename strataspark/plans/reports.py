"""Text reports as ordered lines, and exports of survey tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.residuals import rms


def residual_listing(rows: DataFrame) -> DataFrame:
    """Fixed-width lines ``rank, line`` of a residual list, worst plan residual first.

    Needs ``point_id, kind, image, res_x, res_y, res_z, x, y, z``. Widths: id 9, residuals 11.3, kind 6, image 17, ground 17.3.
    """
    from ..operators.ranks import global_rank

    plan = F.sqrt(F.col("res_x") * F.col("res_x") + F.col("res_y") * F.col("res_y"))
    kind = F.when(F.col("kind") == "gcp", "GCP").when(F.col("kind") == "tie", "TP").when(F.col("kind") == "check", "Check").otherwise(F.col("kind"))
    line = F.format_string("%9s%11.3f%11.3f%11.3f%11.3f%6s  %-17s%17.3f%17.3f%17.3f", F.col("point_id").cast("string"), plan, F.col("res_x"), F.col("res_y"), F.col("res_z"), kind, F.col("image"), F.col("x"), F.col("y"), F.col("z"))
    ranked = global_rank(rows.withColumns({"__p": -F.round(plan, 3), "__line": line}), ["__p", "point_id", "image", "__line"], "rank")
    return ranked.select("rank", F.col("__line").alias("line"))


def table_lines(rows: DataFrame, columns: list[tuple[str, str, int | None]], order: list[str]) -> DataFrame:
    """A table whose columns are as wide as their widest cell: ``rank, line``. ``columns``: name, header, decimals (None: text).

    Widths are one row of aggregates.
    """
    from ..operators.ranks import global_rank

    cell = lambda n, d: F.coalesce(F.col(n).cast("string") if d is None else F.when(F.col(n).isNotNull(), F.format_string(f"%.{d}f", F.col(n))), F.lit(""))
    wide = rows.agg(*[F.greatest(F.coalesce(F.max(F.length(cell(n, d))), F.lit(0)), F.lit(len(h))).alias(f"w{k}") for k, (n, h, d) in enumerate(columns)]).head()
    widths = [wide[f"w{k}"] for k in range(len(columns))]
    body = global_rank(rows, order, "rank").select((F.col("rank") + 2).alias("rank"), F.concat_ws(" ", *[F.lpad(cell(n, d), w, " ") for (n, _, d), w in zip(columns, widths, strict=True)]).alias("line"))
    head = " ".join(h.rjust(w) for (_, h, _), w in zip(columns, widths, strict=True))
    top = rows.sparkSession.range(2).select(F.col("id").alias("rank"), F.when(F.col("id") == 0, head).otherwise("-" * len(head)).alias("line"))
    return top.unionByName(body)


def summary_lines(rows: DataFrame) -> DataFrame:
    """One line for each kind of residual: count and RMS in the three axes."""
    s = rows.groupBy("kind").agg(F.count_distinct("point_id").alias("n"), *[rms(F.col(c)).alias(c) for c in ("res_x", "res_y", "res_z")])
    return s.select("kind", F.format_string("%-6s %8d %11.3f %11.3f %11.3f", "kind", "n", "res_x", "res_y", "res_z").alias("line"))


def control_export(control: DataFrame, residuals: DataFrame | None = None) -> DataFrame:
    """Control points as they are written: id, type, place, and residuals to four decimals with their length."""
    base = control.select("id", F.when(F.col("is_check"), "check").otherwise("control").alias("type"), "x", "y", "z")
    if residuals is None:
        return base
    r = residuals.select("id", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")], F.round(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2), 4).alias("residual"))
    return base.join(r, "id", "left")


def exterior_export(images: DataFrame, units: str = "degrees") -> DataFrame:
    """Orientations of the photos that have one, angles to seven decimals."""
    turn = (lambda c: F.degrees(c)) if units == "degrees" else F.col
    return images.filter(F.col("X0").isNotNull()).select("image", "X0", "Y0", "Z0", *[F.round(turn(c), 7).alias(c) for c in ("omega", "phi", "kappa")])


def point_features(points: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON features of points, one a row: ``feature``."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def box_features(frames: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON polygons of boxes ``west, south, east, north``."""
    corner = lambda a, b: F.array(a, b)
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return frames.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """CSV with a header; empty cells for nulls, as many files as partitions."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str, order: str = "rank") -> None:
    """Lines in order, over files in order; CR and LF between them."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def provenance(df: DataFrame, author: str, project: str, source: str) -> DataFrame:
    """The table with its provenance as a column of tags."""
    tags: list[Column] = [F.lit(v) for kv in (("author", author), ("project", project), ("source", source)) for v in kv]
    return df.withColumn("provenance", F.map_concat(F.create_map(*tags), F.create_map(F.lit("date"), F.current_date().cast("string"))))
