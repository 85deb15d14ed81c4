"""Queries that go through files: each writes supplied rows in a format, reads them back, and answers from what it read."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cameras, diagnostics, fits, neighbours
from ..session import shared_dir
from ..sources import las, rasters, survey, tiles
from ..sources.blobs import write_files
from ..streaming import events as S
from .catalogue import query
from .reports import provenance, write_lines
from .tables import FULL, GRID, KEYS, POINTS, full_surface, near, points, rounded


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text_file(lines: DataFrame, path: str) -> str:
    """A text file of ``line`` by ``rank``, as a survey office hands it over: one task writes it as it reads."""
    lines.repartition(1).sortWithinPartitions("rank").select("line").write.text(path)
    return path


# ---- point clouds ------------------------------------------------------------------------------

_CLOUD = f"{POINTS}, q AS (SELECT round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, least(return_number, 7) AS return_number, least(number_of_returns, 7) AS number_of_returns, classification FROM p)"


def _cloud(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "las")
    p = points(spark, d).withColumns({c: F.least(F.col(c), F.lit(7)) for c in ("return_number", "number_of_returns")})
    las.write_las(p, path, scale=0.01, most=20_000)
    return path


@query("las_points", f"""WITH {_CLOUD} SELECT x, y, z, return_number::SMALLINT AS return_number, number_of_returns::SMALLINT AS number_of_returns, classification::SMALLINT AS classification, count(*) AS n
FROM q GROUP BY ALL""")
def _(t, spark, d):
    read = las.read_las(spark, _cloud(spark, d), chunk=5000)
    place = [near(c, 2).alias(c) for c in "xyz"]
    return read.select(*place, "return_number", "number_of_returns", "classification").groupBy("x", "y", "z", "return_number", "number_of_returns", "classification").agg(F.count(F.lit(1)).alias("n"))


@query("las_columns", f"WITH {_CLOUD} SELECT classification::SMALLINT AS classification, count(*) AS n, max(z) AS high FROM q GROUP BY 1")
def _(t, spark, d):
    return las.read_las(spark, _cloud(spark, d)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), near(F.max("z"), 2).alias("high"))


@query("las_header", f"WITH {_CLOUD} SELECT count(*)::BIGINT AS points, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, min(z) AS low, max(z) AS high FROM q")
def _(t, spark, d):
    h = las.read_headers(spark, _cloud(spark, d))
    ends = {"west": F.min, "east": F.max, "south": F.min, "north": F.max, "low": F.min, "high": F.max}
    return h.agg(F.sum("points").alias("points"), *[near(f(c), 2).alias(c) for c, f in ends.items()])


_TILE = (10_000.0, "10000.0")
_BOX = (20_500.0, 10.0, 61_000.25, 30.0)


@query("tiles_box", f"WITH {POINTS} SELECT l_orderkey, l_linenumber, x, y, z FROM p WHERE x BETWEEN {_BOX[0]} AND {_BOX[2]} AND y BETWEEN {_BOX[1]} AND {_BOX[3]}")
def _(t, spark, d):
    path = scratch(spark, "tiles")
    tiles.write_tiles(points(spark, d), path, _TILE[0])
    return tiles.read_box(spark, path, _TILE[0], _BOX).select("l_orderkey", "l_linenumber", "x", "y", "z")


@query("tiles_index", f"WITH {POINTS} SELECT floor(x / {_TILE[1]})::INT AS tile_x, floor(y / {_TILE[1]})::INT AS tile_y, count(*) AS n FROM p GROUP BY 1, 2")
def _(t, spark, d):
    path = scratch(spark, "tiles")
    tiles.write_tiles(points(spark, d), path, _TILE[0])
    if not tiles.has_tiles(spark, path) or tiles.has_tiles(spark, f"{path}-none"):
        raise ValueError("the layout is not recognised")
    return tiles.tile_index(spark, path)


@query("relabel_noise", f"""WITH {POINTS}, k AS (SELECT l_orderkey, l_linenumber, classification, z, l_tax > 0.03 AND z > 2 AS noise FROM p)
SELECT l_orderkey, l_linenumber, (CASE WHEN classification IN (7, 18) OR NOT noise THEN classification WHEN z < 4 THEN 7 ELSE 18 END)::SMALLINT AS classification, count(*) AS n FROM k GROUP BY ALL""")
def _(t, spark, d):
    p = points(spark, d).withColumn("index", F.concat_ws("-", *KEYS, "x", "y", "z", "l_tax", "classification"))
    noise = p.select("index", ((F.col("l_tax") > 0.03) & (F.col("z") > 2)).alias("noise")).distinct()
    return neighbours.relabel(p, noise, F.col("z") < 4).groupBy("l_orderkey", "l_linenumber", "classification").agg(F.count(F.lit(1)).alias("n"))


# ---- rasters -----------------------------------------------------------------------------------

def _tiffs(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "tiff")
    rasters.write_tiff(full_surface(spark, d), GRID, path, rows_a_file=4)
    return path


def _read_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the files of a folder on the grid that their places give."""
    info = rasters.tiff_info(spark, path).select("file", "north", "cell_y")
    first = F.round((F.lit(GRID.north) - F.col("north")) / F.col("cell_y")).cast("int")
    return rasters.read_tiff(spark, path).join(info, "file").select((F.col("row") + first).alias("row"), "col", "value")


@query("tiff_cells", f'WITH {FULL} SELECT "row", col, value::FLOAT::DOUBLE AS value FROM f')
def _(t, spark, d):
    return _read_tiffs(spark, _tiffs(spark, d)).select("row", "col", near("value", 9).alias("value"))


@query("tiff_header", f"""SELECT {GRID.cols} AS width, least(4, {GRID.rows} - 4 * k)::INT AS height, 1 AS bands, {GRID.west}::DOUBLE AS west, {GRID.north}::DOUBLE - 4 * k * {GRID.cell_y} AS north,
{GRID.cell_x}::DOUBLE AS cell_x, {GRID.cell_y}::DOUBLE AS cell_y, -9999.0::DOUBLE AS nodata FROM (SELECT unnest(range({math.ceil(GRID.rows / 4)})) AS k)""")
def _(t, spark, d):
    return rasters.tiff_info(spark, _tiffs(spark, d)).select("width", "height", "bands", "west", "north", "cell_x", "cell_y", "nodata")


@query("tiff_window", f'WITH {FULL} SELECT "row", col, value::FLOAT::DOUBLE AS value FROM f WHERE "row" % 4 BETWEEN 1 AND 2 AND col BETWEEN 10 AND 39')
def _(t, spark, d):
    """Two rows and thirty columns of each file."""
    path = _tiffs(spark, d)
    info = rasters.tiff_info(spark, path).select("file", "north", "cell_y")
    first = F.round((F.lit(GRID.north) - F.col("north")) / F.col("cell_y")).cast("int")
    cells = rasters.read_tiff(spark, path, (1, 10, 2, 30)).join(info, "file")
    return cells.select((F.col("row") + first).alias("row"), "col", near("value", 9).alias("value"))


@query("tiff_overview", f"""WITH {FULL}, g AS (SELECT "row", col, value::FLOAT::DOUBLE AS value FROM f) SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(value), 6) AS value FROM g WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(t, spark, d):
    cells = _read_tiffs(spark, _tiffs(spark, d)).filter("value is not null")
    return rounded(cells.groupBy(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 4).cast("int").alias("col")).agg(F.avg("value").alias("value")))


@query("text_grid", f'WITH {FULL} SELECT "row", col, value FROM f')
def _(t, spark, d):
    cells = full_surface(spark, d)
    head = [f"ncols {GRID.cols}", f"nrows {GRID.rows}", f"xllcorner {GRID.west}", f"yllcorner {GRID.north - GRID.rows * GRID.cell_y}", f"cellsize {GRID.cell_x}", "nodata_value -9999"]
    value = F.coalesce(F.format_string("%.6f", F.col("value")), F.lit("-9999"))
    rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))).alias("r"))  # one row of the lattice, whose width is fixed
    lines = rows.select((F.col("row") + len(head)).alias("rank"), F.array_join(F.transform("r", lambda x: x["v"]), " ").alias("line"))
    first = spark.createDataFrame(list(enumerate(head)), "rank int, line string")
    read, _ = rasters.read_text_grid(spark, _text_file(lines.unionByName(first), scratch(spark, "grid")))
    return rounded(read)


# ---- survey tables -----------------------------------------------------------------------------

def _comma(c: str):
    return F.replace(F.format_string("%.2f", F.col(c)), F.lit("."), F.lit(","))


def _control(spark: SparkSession, t) -> tuple[DataFrame, DataFrame]:
    s = t("supplier").withColumn("rank", F.col("s_suppkey").cast("int"))
    east = F.when(F.col("s_nationkey") == 3, F.lit("")).otherwise(_comma("s_acctbal"))
    north = F.when(F.col("s_nationkey") == 5, F.lit("n/a")).otherwise(F.format_string("%d", F.col("s_suppkey") * 10))
    line = F.concat_ws(";", F.format_string("P%d", "s_suppkey"), F.format_string("%d", "s_nationkey"), east, north, F.when(F.col("s_nationkey") % 2 == 0, "Check").otherwise("Control"))
    head = spark.createDataFrame([(-1, "﻿Point No;Elevation;Easting;Northing;Type"), (0, "# a remark")], "rank int, line string")
    return survey.read_control(spark, _text_file(s.select("rank", line.alias("line")).unionByName(head), scratch(spark, "control")))


@query("control_file", """SELECT 'P' || s_suppkey AS id, round(s_acctbal, 2) AS x, s_suppkey * 10.0::DOUBLE AS y, s_nationkey::DOUBLE AS z, s_nationkey % 2 = 0 AS is_check FROM supplier WHERE s_nationkey NOT IN (3, 5)""")
def _(t, spark, d):
    return _control(spark, t)[0].select("id", near("x", 2).alias("x"), "y", "z", "is_check")


@query("control_rejects", "SELECT (s_suppkey + 3)::BIGINT AS line, CASE s_nationkey WHEN 3 THEN 'no x' ELSE 'no y' END AS reason FROM supplier WHERE s_nationkey IN (3, 5)")
def _(t, spark, d):
    return _control(spark, t)[1].select(F.col("line").cast("long").alias("line"), "reason")


@query("flight_log", """SELECT 'IMG_' || s_suppkey || '.tif' AS image, round(s_acctbal, 2) AS x, s_suppkey::DOUBLE AS y, 900.5::DOUBLE AS z, round(radians(s_nationkey::DOUBLE), 9) AS omega, round(radians(-s_nationkey::DOUBLE), 9) AS phi,
round(radians((s_suppkey * 7 % 360)::DOUBLE), 9) AS kappa FROM supplier""")
def _(t, spark, d):
    s = t("supplier")
    line = F.concat_ws(",", F.format_string("IMG_%d.tif", "s_suppkey"), F.format_string("%.2f", "s_acctbal"), F.format_string("%d", "s_suppkey"), F.lit("900.5"), F.format_string("%d", "s_nationkey"), F.format_string("%d", -F.col("s_nationkey")), F.format_string("%d", F.col("s_suppkey") * 7 % 360))
    head = spark.createDataFrame([(0, "Photo,Easting,Northing,Altitude,Roll,Pitch,Yaw")], "rank int, line string")
    good, _ = survey.read_exterior(spark, _text_file(s.select(F.col("s_suppkey").cast("int").alias("rank"), line.alias("line")).unionByName(head), scratch(spark, "flight")))
    return good.select("image", near("x", 2).alias("x"), "y", "z", *[near(c, 9).alias(c) for c in ("omega", "phi", "kappa")])


_SNIFFS = {"semicolon": ";", "tab": "\t", "bar": "|", "comma": ",", "blank": " "}


@query("table_sniff", " UNION ALL ".join(f"SELECT '{n}' AS file, n_nationkey AS line, n_nationkey::VARCHAR AS id, (n_regionkey * 2)::VARCHAR AS x, (n_nationkey + 5)::VARCHAR AS y FROM nation" for n in _SNIFFS))
def _(t, spark, d):
    out = None
    for name, sep in _SNIFFS.items():
        line = F.concat_ws(sep, F.col("n_nationkey").cast("string"), (F.col("n_regionkey") * 2).cast("string"), (F.col("n_nationkey") + 5).cast("string"))
        rows = t("nation").select((F.col("n_nationkey") + 1).cast("int").alias("rank"), line.alias("line"))
        head = spark.createDataFrame([(0, sep.join(["Station", "East", "North"]))], "rank int, line string")
        read, _ = survey.read_table(spark, _text_file(rows.unionByName(head), scratch(spark, f"sniff-{name}")), ["id", "x", "y"])
        one = read.select(F.lit(name).alias("file"), (F.col("line") - 2).cast("long").alias("line"), "id", "x", "y")
        out = one if out is None else out.unionByName(one)
    return out


@query("camera_library", """SELECT n_name AS label, '{"focal_mm":' || (n_nationkey + 10) || '}' AS camera FROM nation WHERE n_name <> 'CHINA' UNION ALL SELECT 'CHINA', '{"focal_mm":99}' UNION ALL SELECT 'NEW', '{"focal_mm":1}'""")
def _(t, spark, d):
    rows = t("nation").select(F.struct(F.col("n_name").alias("label"), F.format_string('{"focal_mm":%d}', F.col("n_nationkey") + 10).alias("camera")).alias("c"))
    doc = rows.agg(F.collect_list("c").alias("cameras")).select(F.to_json(F.struct(F.lit(1).alias("version"), "cameras")).cast("binary").alias("content"), F.lit("cameras.json").alias("name"))
    path = scratch(spark, "cameras")
    write_files(doc, path)
    library = survey.read_cameras(spark, f"{path}/cameras.json")
    return survey.save_camera(survey.save_camera(library, "CHINA", '{"focal_mm":99}'), "NEW", '{"focal_mm":1}')


# A model of a few terms for each region: the sample follows the longitude and its product with the height, the line the latitude.
_RPC_KEYS = ["LINE_OFF", "SAMP_OFF", "LAT_OFF", "LONG_OFF", "HEIGHT_OFF", "LINE_SCALE", "SAMP_SCALE", "LAT_SCALE", "LONG_SCALE", "HEIGHT_SCALE"]
_RPC_VALUES = [1000.0, 2000.0, -25.0, 30.0, 500.0, 900.0, 1800.0, 0.5, 0.25, 400.0]
_RPC_LISTS = {"LINE_NUM": {1: 0.01, 3: 1.1}, "LINE_DEN": {1: 1.0, 2: 0.02}, "SAMP_NUM": {1: 0.02, 2: 0.9, 6: 0.05}, "SAMP_DEN": {1: 1.0, 4: 0.03}}


def _rpc_files(spark: SparkSession, t) -> DataFrame:
    """A sidecar for each region, in the spellings that are in use, and the models read back from them."""
    key, value = F.col("r_regionkey"), lambda v, k: F.format_string("%.4f", F.lit(v) + F.col("r_regionkey") * k)
    lines = [F.concat(F.lit(f"{n}: "), value(v, 10.0 if n == "LINE_OFF" else 0.0), F.lit(" units")) for n, v in zip(_RPC_KEYS, _RPC_VALUES, strict=True)]
    for name, coefficients in _RPC_LISTS.items():
        lines += [F.when(key % 2 == 0, f"{name}_COEFF_{k}: {coefficients.get(k, 0.0)}").otherwise(f"{name.replace('_', '').lower()}Coef_{k}={coefficients.get(k, 0.0)}") for k in range(1, 21)]
    path = scratch(spark, "rpc")
    write_files(t("region").select(F.format_string("region-%d_RPC.TXT", key).alias("name"), F.concat_ws("\n", *lines).cast("binary").alias("content")), path)
    return survey.read_rpc(spark, path).withColumn("region", F.regexp_extract("file", r"region-(\d+)_RPC", 1).cast("long"))


@query("rpc_sidecars", f"SELECT r_regionkey AS region, {_RPC_VALUES[0]} + 10.0 * r_regionkey AS line_off, {_RPC_VALUES[8]} AS long_scale, {len(_RPC_LISTS)} AS lists, 80 AS coefficients, {sum(sum(v.values()) for v in _RPC_LISTS.values()):.4f} AS total FROM region")
def _(t, spark, d):
    lists = F.array(*[F.col(n) for n in survey.RPC_LISTS])
    flat = F.flatten(lists)
    return _rpc_files(spark, t).select("region", "line_off", "long_scale", F.size(lists).alias("lists"), F.size(flat).alias("coefficients"), near(F.aggregate(flat, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_GROUND = "30 + (c_custkey % 100) / 500.0 AS lon, -25 + (c_nationkey - 12) / 40.0 AS lat, 500 + c_acctbal / 40 AS h"


@query("rpc_forward", f"""WITH g AS (SELECT c_custkey, (lon - 30) / 0.25 AS l, (lat + 25) / 0.5 AS p, (h - 500) / 400 AS z FROM (SELECT c_custkey, {_GROUND} FROM customer))
SELECT c_custkey, round((0.02 + 0.9 * l + 0.05 * l * z) / (1 + 0.03 * z) * 1800 + 2000, 6) AS sample, round((0.01 + 1.1 * p) / (1 + 0.02 * l) * 900 + 1000, 6) AS line FROM g""")
def _(t, spark, d):
    model = _rpc_files(spark, t).filter("region = 0").head().asDict()
    g = t("customer").select("c_custkey", (30 + F.col("c_custkey") % 100 / 500.0).alias("lon"), (-25 + (F.col("c_nationkey") - 12) / 40.0).alias("lat"), (500 + F.col("c_acctbal") / 40).alias("h"))
    sample, line = G.rpc_forward(F.col("lon"), F.col("lat"), F.col("h"), model)
    return rounded(g.select("c_custkey", sample.alias("sample"), line.alias("line")))


@query("rpc_inverse", f"SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM (SELECT c_custkey, {_GROUND} FROM customer)")
def _(t, spark, d):
    model = _rpc_files(spark, t).filter("region = 0").head().asDict()
    g = t("customer").select("c_custkey", (30 + F.col("c_custkey") % 100 / 500.0).alias("lon"), (-25 + (F.col("c_nationkey") - 12) / 40.0).alias("lat"), (500 + F.col("c_acctbal") / 40).alias("h"))
    sample, line = G.rpc_forward(F.col("lon"), F.col("lat"), F.col("h"), model)
    seen = g.select("c_custkey", "h", sample.alias("s"), line.alias("l"))
    lon, lat = G.rpc_inverse(F.col("s"), F.col("l"), F.col("h"), model)
    return seen.select("c_custkey", near(lon, 7).alias("lon"), near(lat, 7).alias("lat"))


def _project(spark: SparkSession, t) -> dict[str, DataFrame]:
    images = t("supplier").agg(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.concat("s_name", F.lit(".tif")).alias("name"), F.array(F.col("s_acctbal"), F.lit(0.0)).alias("exterior"))).alias("images"))
    gcps = t("nation").agg(F.collect_list(F.struct(F.col("n_name").alias("id"), F.col("n_nationkey").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("n_regionkey") == 0).alias("isCheck"))).alias("gcps"))
    seen = t("part").filter("p_size is not null").agg(F.collect_list(F.struct((F.col("p_partkey") % 10 + 1).cast("string").alias("imageId"), F.col("p_partkey").cast("string").alias("pointId"), F.col("p_size").cast("double").alias("col"), F.col("p_retailprice").alias("row"))).alias("observations"))
    doc = images.crossJoin(gcps).crossJoin(seen).select(F.lit("project.json").alias("name"), F.to_json(F.struct("images", "gcps", "observations")).cast("binary").alias("content"))
    path = scratch(spark, "project")
    write_files(doc, path)
    return survey.read_project(spark, f"{path}/project.json")


@query("project_observations", "SELECT (p_partkey % 10 + 1)::VARCHAR AS image, p_partkey::VARCHAR AS point, p_size::DOUBLE AS col, p_retailprice AS \"row\" FROM part WHERE p_size IS NOT NULL")
def _(t, spark, d):
    return _project(spark, t)["observations"].select(F.col("imageId").alias("image"), F.col("pointId").alias("point"), "col", "row")


@query("project_summary", """SELECT (SELECT count(*) FROM supplier) AS images, (SELECT count(*) FROM nation WHERE n_regionkey <> 0) AS control, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS checks,
0::BIGINT AS ties, (SELECT count(*) FROM part WHERE p_size IS NOT NULL) AS observations""")
def _(t, spark, d):
    p = _project(spark, t)
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(p["images"], "images").crossJoin(n(p["gcps"].filter("not isCheck"), "control")).crossJoin(n(p["gcps"].filter("isCheck"), "checks")).crossJoin(n(p["tie_points"], "ties")).crossJoin(n(p["observations"], "observations"))


# ---- exports -----------------------------------------------------------------------------------

@query("lines_file", "SELECT s_suppkey::VARCHAR || ' ' || s_name AS line FROM supplier")
def _(t, spark, d):
    path = scratch(spark, "lines")
    write_lines(t("supplier").select(F.col("s_suppkey").alias("rank"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name").alias("line")), path)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


@query("provenance_tags", "SELECT s_suppkey, tag, v FROM supplier, (VALUES ('author', 'a'), ('project', 'p'), ('source', 's')) x(tag, v)")
def _(t, spark, d):
    path = scratch(spark, "tagged")
    provenance(t("supplier").select("s_suppkey"), "a", "p", "s").write.parquet(path)
    return spark.read.parquet(path).select("s_suppkey", F.explode("provenance").alias("tag", "v")).filter("tag <> 'date'")


@query("colmap_lines", "SELECT s_suppkey AS image_id, 10::BIGINT AS fields, round(1.0, 9) AS norm, s_suppkey::VARCHAR AS first, s_name AS last FROM supplier")
def _(t, spark, d):
    turn = lambda k: F.radians(F.col("s_nationkey") * k)
    images = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_acctbal").alias("X0"), F.lit(5.0).alias("Y0"), F.lit(900.0).alias("Z0"), turn(0.3).alias("omega"), turn(-0.2).alias("phi"), turn(7.0).alias("kappa"), F.lit(1).alias("camera_id"), F.regexp_replace("s_name", " ", "_").alias("name"))
    f = F.split("line", " ")
    norm = F.sqrt(F.aggregate(F.transform(F.slice(f, 2, 4), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return diagnostics.colmap_images(images).select("image_id", F.size(f).cast("long").alias("fields"), near(norm, 9).alias("norm"), f[0].alias("first"), f[9].alias("last"))


# ---- cameras and fits --------------------------------------------------------------------------

@query("gimbal_down", "SELECT s_suppkey, round(0.0, 9) AS omega, round(0.0, 9) AS phi, round(CASE WHEN a > 180 THEN radians(360 - a) ELSE radians(-a) END, 9) AS kappa FROM (SELECT s_suppkey, (s_suppkey * 7 % 359 + 0.25)::DOUBLE AS a FROM supplier)")
def _(t, spark, d):
    angles = cameras.attitude_from_gimbal((F.col("s_suppkey") * 7 % 359 + 0.25).cast("double"), F.lit(-90.0))
    return t("supplier").select("s_suppkey", *[F.abs(near(a, 9)).alias(n) if n != "kappa" else near(a, 9).alias(n) for a, n in zip(angles, ("omega", "phi", "kappa"), strict=True)])


@query("pixel_pitch", """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size / 4000.0 WHEN 1 THEN 25.4 / (p_size * 10.0) WHEN 2 THEN 10.0 / (p_size * 10.0) ELSE 36.0 * 8.8 / 24 / 4000 END, 9) AS pitch FROM part""")
def _(t, spark, d):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    pitch = cameras.pixel_pitch(F.when(kind == 0, size), F.lit(4000.0), F.lit(8.8), F.when(kind == 3, 24.0), F.when(kind.isin(1, 2), size * 10), F.when(kind == 1, 2).when(kind == 2, 3))
    return t("part").select("p_partkey", near(pitch, 9).alias("pitch"))


@query("similarity_fit", "SELECT 2.5::DOUBLE AS scale, round(cos(0.7), 6) AS c, round(sin(0.7), 6) AS s, 10.0::DOUBLE AS tx, -20.0::DOUBLE AS ty, 3.5::DOUBLE AS tz, count(*) AS n FROM part")
def _(t, spark, d):
    x, y, z = F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 17).cast("double")
    c, s = math.cos(0.7), math.sin(0.7)
    pairs = t("part").select(x.alias("sx"), y.alias("sy"), z.alias("sz"), (2.5 * (c * x - s * y) + 10).alias("tx"), (2.5 * (s * x + c * y) - 20).alias("ty"), (2.5 * z + 3.5).alias("tz"))
    scale, turn, shift = fits.umeyama(pairs)
    found = pairs.agg(F.count(F.lit(1)).alias("n"))
    return rounded(found.select(*[F.lit(float(v)).alias(k) for k, v in (("scale", scale), ("c", turn[0][0]), ("s", turn[1][0]), ("tx", shift[0]), ("ty", shift[1]), ("tz", shift[2]))], "n"))


@query("rpc_refinement", "SELECT 3.0::DOUBLE AS shift, 1.0::DOUBLE AS a, 0.002::DOUBLE AS sx, -0.001::DOUBLE AS sy")
def _(t, spark, d):
    s, line = F.col("p_retailprice"), F.col("p_size") * 40.0
    rows = t("part").select(s.alias("sample"), line.alias("line"), (s + 3 + 0.002 * s - 0.001 * line).alias("sample_seen"), (line + 1).alias("line_seen"))
    x = fits.rpc_refinement(rows)
    flat = [float(v) for v in (x[0][0], x[0][1], x[1][0], x[2][0])] if x.shape == (3, 2) else [float(v) for v in (x[0][0], x[1][0], x[0][1], x[0][2])]
    return rounded(spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(("shift", "a", "sx", "sy"), flat, strict=True)]))


@query("similarity_points", "SELECT s_suppkey, round(2 * (0.6 * s_acctbal - 0.8 * s_nationkey) + 1, 6) AS x, round(2 * (0.8 * s_acctbal + 0.6 * s_nationkey) + 2, 6) AS y, round(2.0 * s_suppkey + 3, 6) AS z FROM supplier")
def _(t, spark, d):
    p = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.col("s_suppkey").cast("double").alias("z"))
    return rounded(diagnostics.similarity_3d(p, 2.0, [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0]))


# ---- streams -----------------------------------------------------------------------------------

def _stream(spark: SparkSession, t, name: str) -> DataFrame:
    path = scratch(spark, name)
    events = t("events").select("event_id", "event_type", "value")
    events.write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


@query("journal_append", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def _(t, spark, d):
    to = scratch(spark, "journal")
    S.append_journal(_stream(spark, t, "journal-in"), to, f"{to}-offsets").awaitTermination()
    return spark.read.parquet(to).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
