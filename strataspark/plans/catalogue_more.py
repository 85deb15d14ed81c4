"""Queries of the pipelines: terrain, mosaics, reports, cameras, features."""

from __future__ import annotations

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import block, cameras, diagnostics, features, fits, grid, levelling, meshes, neighbours, relative, seams, stencils, volumes
from ..operators.quantiles import exact_quantiles, middle
from ..operators.triangles import delaunay, pit_free, tin_grid
from . import mosaic, reports, terrain
from .catalogue import _PATCHES, hyp, query
from .tables import CELLS, FULL, GRID, KEYS, SURFACE, TWO, full_surface, near, points, rounded, surface

_R = 3
_NEAREST = f"""{FULL}, d AS (SELECT f."row", f.col, min(row(i.a * i.a + j.b * j.b, s.value)) AS m FROM f, (SELECT unnest(range(-{_R}, {_R + 1})) AS a) i, (SELECT unnest(range(-{_R}, {_R + 1})) AS b) j
JOIN f s ON s."row" = f."row" + i.a AND s.col = f.col + j.b WHERE i.a * i.a + j.b * j.b <= {_R * _R} AND s.value IS NOT NULL GROUP BY f."row", f.col)"""


@query("distance_transform", f'WITH {_NEAREST} SELECT f."row", f.col, m[1]::BIGINT AS d2 FROM f LEFT JOIN d USING ("row", col)')
def _(t, spark, d):
    return terrain.nearest_filled(full_surface(spark, d), _R).select("row", "col", "d2")


@query("fill_voids_nearest", f'WITH {_NEAREST} SELECT f."row", f.col, m[2] AS value FROM f LEFT JOIN d USING ("row", col)')
def _(t, spark, d):
    return terrain.fill_voids(full_surface(spark, d), _R)


@query("fill_voids_idw", f"""WITH {FULL}, k AS (SELECT a, b, 1.0 / (a * a + b * b) AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS a) i, (SELECT unnest([-2, -1, 0, 1, 2]) AS b) j WHERE a * a + b * b BETWEEN 1 AND 4),
m AS (SELECT f."row", f.col, sum(k.w * s.value) / sum(k.w) AS made FROM f, k JOIN f s ON s."row" = f."row" + k.a AND s.col = f.col + k.b WHERE f.value IS NULL AND s.value IS NOT NULL GROUP BY ALL)
SELECT f."row", f.col, round(coalesce(f.value, made), 6) AS value FROM f LEFT JOIN m USING ("row", col)""")
def _(t, spark, d):
    return rounded(terrain.fill_voids(full_surface(spark, d), 2, "idw"))


_FILL_HEIGHT = """nv AS (SELECT v."row", v.col, arg_min(s.value, row((v."row" - s."row") * (v."row" - s."row") + (v.col - s.col) * (v.col - s.col), s.value)) AS value
FROM gl v, gl s WHERE v.value IS NULL AND s.value IS NOT NULL GROUP BY v."row", v.col), fl AS (SELECT v."row", v.col, coalesce(v.value, nv.value) AS value FROM gl v LEFT JOIN nv USING ("row", col))"""
_EAST, _SOUTH = GRID.west + (GRID.cols - 0.5) * GRID.cell_x, GRID.north - (GRID.rows - 0.5) * GRID.cell_y


@query("height_model", f"""WITH {CELLS}, dd AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey, x) * FROM c), id AS (SELECT *, row_number() OVER () AS i FROM dd),
gm AS (SELECT "row", col, avg(z) AS value FROM id WHERE classification = 2 GROUP BY ALL),
la AS (SELECT r."row", k.col FROM (SELECT unnest(range({GRID.rows}))::INT AS "row") r, (SELECT unnest(range({GRID.cols}))::INT AS col) k), gl AS (SELECT la."row", la.col, gm.value FROM la LEFT JOIN gm USING ("row", col)),
{_FILL_HEIGHT}, us AS (SELECT i, greatest({GRID.west + GRID.cell_x / 2}, least({_EAST}, x)) AS x, greatest({_SOUTH}, least({GRID.north - GRID.cell_y / 2}, y)) AS y FROM id WHERE classification NOT IN (7, 18)),
fr AS (SELECT i, (x - {GRID.west}) / {GRID.cell_x} - 0.5 AS fx, ({GRID.north} - y) / {GRID.cell_y} - 0.5 AS fy FROM us),
co AS (SELECT i, floor(fx)::INT + b AS col, floor(fy)::INT + a AS "row", (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM fr, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
el AS (SELECT i, CASE WHEN count(*) = count(fl.value) THEN sum(w * fl.value) END AS ground FROM co LEFT JOIN fl USING ("row", col) WHERE w > 0 GROUP BY i),
ov AS (SELECT "row", col, greatest(z - ground, 0.0) AS h FROM id JOIN el USING (i)) SELECT "row", col, round(max(h), 6) AS value, count(*) AS n FROM ov WHERE h <= 100 GROUP BY 1, 2""")
def _(t, spark, d):
    p = points(spark, d).withColumn("index", F.xxhash64(*KEYS, "x")).dropDuplicates(["index"])
    return rounded(terrain.height_above_ground(p, GRID))


@query("ground_filter", None)
def _(t, spark, d):
    p = points(spark, d).select(F.xxhash64(*KEYS, "x").alias("index"), (F.col("x") / 1000).alias("x"), (F.col("y") * 2).alias("y"), "z", F.col("classification").cast("short").alias("classification")).dropDuplicates(["index"])
    return terrain.classify_ground(p, grid.Grid.over(0.0, 0.0, 105.0, 100.0, 5.0), window=10.0)


@query("contour_crossings", f"""WITH {FULL}, e AS (SELECT "row", col, value, lead(value) OVER (PARTITION BY "row" ORDER BY col) AS r, lead(value) OVER (PARTITION BY col ORDER BY "row") AS s FROM f),
pr AS (SELECT "row", col, value, r AS other, true AS across FROM e UNION ALL SELECT "row", col, value, s, false FROM e), k AS (SELECT *, unnest(range(floor(least(value, other) / 0.5)::BIGINT + 1, ceil(greatest(value, other) / 0.5)::BIGINT)) AS k FROM pr WHERE value IS NOT NULL AND other IS NOT NULL AND value <> other)
SELECT k * 0.5 AS level, "row", col, round((k * 0.5 - value) / (other - value), 6) AS share, across, k % 5 = 0 AS is_index FROM k""")
def _(t, spark, d):
    return rounded(terrain.contour_edges(full_surface(spark, d), 0.5))


@query("contour_segments", f"""WITH {FULL}, g AS (SELECT "row", col, value AS a, lead(value) OVER (PARTITION BY "row" ORDER BY col) AS b FROM f),
h AS (SELECT *, lead(a) OVER w AS d, lead(b) OVER w AS c FROM g WINDOW w AS (PARTITION BY col ORDER BY "row")),
k AS (SELECT *, unnest(range(floor(least(a, b, c, d) / 1.7)::BIGINT + 1, floor(greatest(a, b, c, d) / 1.7)::BIGINT + 1)) * 1.7 AS level FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
t AS (SELECT *, (a >= level) <> (b >= level) AS e1, (b >= level) <> (c >= level) AS e2, (d >= level) <> (c >= level) AS e3, (a >= level) <> (d >= level) AS e4, ((a + b + c + d) / 4 >= level) = (a >= level) AS through FROM k),
m AS (SELECT *, [col + (level - a) / (b - a), "row"] AS p1, [col + 1, "row" + (level - b) / (c - b)] AS p2, [col + (level - d) / (c - d), "row" + 1] AS p3, [col, "row" + (level - a) / (d - a)] AS p4 FROM t),
zz AS (SELECT *, unnest(CASE WHEN e1 AND e2 AND e3 AND e4 THEN CASE WHEN through THEN [[p1, p2], [p3, p4]] ELSE [[p1, p4], [p2, p3]] END
  WHEN e1 AND e2 THEN [[p1, p2]] WHEN e1 AND e3 THEN [[p1, p3]] WHEN e1 AND e4 THEN [[p1, p4]] WHEN e2 AND e3 THEN [[p2, p3]] WHEN e2 AND e4 THEN [[p2, p4]] ELSE [[p3, p4]] END) AS z FROM m)
SELECT round(level, 6) AS level, "row", col, round(z[1][1], 5) AS x1, round(z[1][2], 5) AS y1, round(z[2][1], 5) AS x2, round(z[2][2], 5) AS y2 FROM zz""")
def _(t, spark, d):
    lines = terrain.contour_segments(full_surface(spark, d), 1.7)
    return lines.select(near("level", 6).alias("level"), "row", "col", *[near(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


_PLACE = '(((k + 32768) << 46) | (("row" + {r})::BIGINT << 23) | ((col + {c})::BIGINT << 1) | {s})'
_E1, _E2, _E3, _E4 = (_PLACE.format(r=r, c=c, s=s) for r, c, s in ((0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 0, 1)))
# Rings by their least edge: edges that each segment joins, closed over. Length and vertices do not need an order
_RINGS = f"""{FULL}, g AS (SELECT "row", col, value AS a, lead(value) OVER (PARTITION BY "row" ORDER BY col) AS b FROM f),
h AS (SELECT *, lead(a) OVER w AS d, lead(b) OVER w AS c FROM g WINDOW w AS (PARTITION BY col ORDER BY "row")),
k AS (SELECT *, k * 1.7 AS level FROM (SELECT *, unnest(range(floor(least(a, b, c, d) / 1.7)::BIGINT + 1, floor(greatest(a, b, c, d) / 1.7)::BIGINT + 1)) AS k
  FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL)),
t AS (SELECT *, (a >= level) <> (b >= level) AS e1, (b >= level) <> (c >= level) AS e2, (d >= level) <> (c >= level) AS e3, (a >= level) <> (d >= level) AS e4, ((a + b + c + d) / 4 >= level) = (a >= level) AS through FROM k),
m AS (SELECT *, row(col + (level - a) / (b - a), "row", {_E1}) AS p1, row(col + 1, "row" + (level - b) / (c - b), {_E2}) AS p2, row(col + (level - d) / (c - d), "row" + 1, {_E3}) AS p3, row(col, "row" + (level - a) / (d - a), {_E4}) AS p4 FROM t),
zz AS (SELECT k, level, unnest(CASE WHEN e1 AND e2 AND e3 AND e4 THEN CASE WHEN through THEN [[p1, p2], [p3, p4]] ELSE [[p1, p4], [p2, p3]] END
  WHEN e1 AND e2 THEN [[p1, p2]] WHEN e1 AND e3 THEN [[p1, p3]] WHEN e1 AND e4 THEN [[p1, p4]] WHEN e2 AND e3 THEN [[p2, p3]] WHEN e2 AND e4 THEN [[p2, p4]] ELSE [[p3, p4]] END) AS z FROM m),
sg AS (SELECT level, z[1][3] AS u, z[2][3] AS v, sqrt((z[1][1] - z[2][1]) * (z[1][1] - z[2][1]) + (z[1][2] - z[2][2]) * (z[1][2] - z[2][2])) AS long FROM zz),
ed AS (SELECT u AS a, v AS b FROM sg UNION SELECT v, u FROM sg), re AS (SELECT a AS n, a AS r FROM ed UNION SELECT ed.b, re.r FROM re JOIN ed ON ed.a = re.n AND ed.b > re.r),
ro AS (SELECT n, min(r) AS root FROM re GROUP BY n), dg AS (SELECT root, count(*) FILTER (x.ways <> 2) AS loose FROM (SELECT a, count(*) AS ways FROM ed GROUP BY a) x JOIN ro ON ro.n = x.a GROUP BY root),
ri AS (SELECT round(level, 6) AS level, root AS ring, count(*) AS segments, round(sum(long), 6) AS length, loose = 0 AS closed FROM sg JOIN ro ON ro.n = sg.u JOIN dg USING (root) GROUP BY level, root, loose)"""


@query("contour_rings", f"WITH RECURSIVE {_RINGS} SELECT * FROM ri")
def _(t, spark, d):
    return rounded(terrain.contour_rings(terrain.contour_segments(full_surface(spark, d), 1.7)))


@query("contour_lines", f"WITH RECURSIVE {_RINGS} SELECT level, ring AS line, segments + 1 AS vertices, segments AS last_seq, length, closed FROM ri")
def _(t, spark, d):
    lines = terrain.contour_lines(full_surface(spark, d), 1.7, tolerance=0.0, least=0)
    after = Window.partitionBy("line").orderBy("seq")
    step = F.hypot(F.lead("x").over(after) - F.col("x"), F.lead("y").over(after) - F.col("y"))
    ways = lines.withColumn("step", step).groupBy("level", "line", "closed").agg(F.count(F.lit(1)).alias("vertices"), F.max("seq").alias("last_seq"), F.sum("step").alias("length"))
    return rounded(ways)


@query("contour_features", None)
def _(t, spark, d):
    return terrain.contour_features(terrain.contour_lines(full_surface(spark, d), 1.7, tolerance=0.3), GRID)


# The voids of a lattice by the nearest filled cell, ties to the lesser value.
_FILL = """nv AS (SELECT v."row", v.col, arg_min(s.value, row((v."row" - s."row") * (v."row" - s."row") + (v.col - s.col) * (v.col - s.col), s.value)) AS value
FROM {f} v, {f} s WHERE v.value IS NULL AND s.value IS NOT NULL GROUP BY v."row", v.col),
fl AS (SELECT v."row", v.col, coalesce(v.value, nv.value) AS value FROM {f} v LEFT JOIN nv USING ("row", col))"""
_CORNERS = """co AS (SELECT {key}, floor(fx)::INT + b AS col, floor(fy)::INT + a AS "row", (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
FROM {at}, (VALUES (0), (1)) i(a), (VALUES (0), (1)) j(b)),
el AS (SELECT {key}, CASE WHEN count(*) = count(fl.value) THEN sum(w * fl.value) END AS ground FROM co LEFT JOIN fl USING ("row", col) WHERE w > 0 GROUP BY {key})"""
_LINE_OF = [(5000.0, 10.0), (60_000.0, 40.0), (90_000.0, 12.0)]
_LEGS = [(p, q, math.hypot(q[0] - p[0], q[1] - p[1])) for p, q in zip(_LINE_OF, _LINE_OF[1:], strict=False)]
_TOTAL = sum(n for _, _, n in _LEGS)
_LEG_ROWS = ", ".join(f"({sum(n for _, _, n in _LEGS[:k])!r}::DOUBLE, {n!r}::DOUBLE, {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0] - p[0]}::DOUBLE, {q[1] - p[1]}::DOUBLE)" for k, (p, q, n) in enumerate(_LEGS))


@query("profile", f"""WITH {FULL}, {_FILL.format(f="f")}, lg(d0, n, x0, y0, dx, dy) AS (VALUES {_LEG_ROWS}),
sa AS (SELECT k AS sample, k * {_TOTAL!r} / 199 AS distance FROM (SELECT unnest(range(200)) AS k)),
pt AS (SELECT sample, distance, arg_max(row(d0, n, x0, y0, dx, dy), d0) AS l FROM sa JOIN lg ON d0 <= distance GROUP BY ALL),
xy AS (SELECT sample, distance, l[3] + least(1.0, (distance - l[1]) / l[2]) * l[5] AS x, l[4] + least(1.0, (distance - l[1]) / l[2]) * l[6] AS y FROM pt),
fr AS (SELECT *, x / 1000.0 - 0.5 AS fx, ({GRID.north} - y) / 5.0 - 0.5 AS fy FROM xy), {_CORNERS.format(key="sample", at="fr")}
SELECT sample, round(distance, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y, round(ground, 6) AS elevation,
round((lead(ground) OVER (ORDER BY sample) - lag(ground) OVER (ORDER BY sample)) / (2 * {_TOTAL!r} / 199), 6) AS gradient FROM xy JOIN el USING (sample)""")
def _(t, spark, d):
    return rounded(terrain.profile(terrain.fill_all(full_surface(spark, d)), GRID, [(5000.0, 10.0), (60_000.0, 40.0), (90_000.0, 12.0)], 200))


@query("orthophoto", None)
def _(t, spark, d):
    dem = terrain.fill_all(full_surface(spark, d)).withColumn("value", F.col("value") * 10)
    image = grid.lattice(spark, grid.Grid(0, 0, 1, 1, 120, 90)).withColumn("value", (F.col("row") * 3 + F.col("col") * 2).cast("double"))
    g = grid.Grid(0.0, 55.0 * 1000, 1000.0, 5000.0, GRID.cols, GRID.rows)
    return rounded(terrain.orthorectify(dem, g, image, 120, 90, 0.5, 50.0, (52_000.0, 27_000.0, 90_000.0, 0.0, 0.0, 0.0)), 4)


@query("depth_buffer", "SELECT floor(l_quantity / 5)::INT AS \"row\", floor(l_extendedprice / 5)::INT AS col, min(l_discount) AS depth FROM lineitem GROUP BY 1, 2")
def _(t, spark, d):
    return terrain.depth_buffer(t("lineitem").select(F.col("l_extendedprice").alias("u"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("depth")), 5.0)


@query("despeckle", f'WITH RECURSIVE {_PATCHES} SELECT f."row", f.col, round(f.value, 6) AS value FROM f JOIN pt ON pt.node = f.id JOIN sz USING (patch) WHERE sz.cells >= 4')
def _(t, spark, d):
    return rounded(terrain.despeckle(surface(spark, d).filter("value > 5").select("row", "col", "value"), 4))


_LAYERS = f'{CELLS}, s AS (SELECT l_orderkey % 4 AS layer, "row", col, avg(z) AS value FROM c GROUP BY ALL)'


def _layers(spark, d):
    cells = grid.with_cells(points(spark, d), GRID)
    return cells.groupBy((F.col("l_orderkey") % 4).alias("layer"), "row", "col").agg(F.avg("z").alias("value"))


@query("mosaic_overlap_pairs", f'WITH {_LAYERS} SELECT a.layer AS i, b.layer AS j, count(*) AS n, round(avg(a.value), 6) AS mean_i, round(avg(b.value), 6) AS mean_j, round(stddev_pop(a.value), 6) AS std_i, round(stddev_pop(b.value), 6) AS std_j FROM s a JOIN s b ON a."row" = b."row" AND a.col = b.col AND a.layer < b.layer GROUP BY ALL HAVING count(*) >= 50')
def _(t, spark, d):
    return rounded(terrain.shared_cells(_layers(spark, d)))


@query("mosaic_order", f'WITH {_LAYERS} SELECT "row", col, round(arg_min(value, layer), 6) AS value FROM s GROUP BY "row", col')
def _(t, spark, d):
    return rounded(mosaic.blend(_layers(spark, d), "order"))


@query("mosaic_nearest_center", f"""WITH {_LAYERS}, m AS (SELECT layer, avg("row") AS r, avg(col) AS c FROM s GROUP BY layer), w AS (SELECT s.*, 1000.0 / (1.0 + {hyp('"row" - r', 'col - c')}) AS depth FROM s JOIN m USING (layer)),
b AS (SELECT *, exp((depth - max(depth) OVER (PARTITION BY "row", col)) / 20.0) AS k FROM w) SELECT "row", col, round(sum(k * value) / sum(k), 6) AS value FROM b GROUP BY "row", col""")
def _(t, spark, d):
    return rounded(mosaic.blend(_layers(spark, d), "nearest_center"))


@query("mosaic_gains", None)
def _(t, spark, d):
    found = mosaic.gains(_layers(spark, d))
    return spark.createDataFrame([(int(k), round(g, 6), round(o, 6)) for k, (g, o) in found.items()], "layer int, gain double, shift double")


_SHARES = ", ".join(f"{k / 100}" for k in range(101))


@query("quantile_match", f"""WITH {TWO}, bo AS (SELECT a.value AS va, b.value AS vb FROM a JOIN b USING ("row", col)),
q AS (SELECT unnest(range(101)) AS k, unnest(quantile_cont(va, [{_SHARES}])) AS qa, unnest(quantile_cont(vb, [{_SHARES}])) AS qb FROM bo),
ac AS (SELECT k, max(qa + k * 1e-6) OVER (ORDER BY k) AS a0, qb AS b0 FROM q), st AS (SELECT k, a0, b0, lead(a0) OVER (ORDER BY k) AS a1, lead(b0) OVER (ORDER BY k) AS b1, max(a0) OVER () AS top, min(a0) OVER () AS low FROM ac),
ce AS (SELECT "row", col, greatest((SELECT any_value(low) FROM st), least((SELECT any_value(top) FROM st), value)) AS v FROM a),
pk AS (SELECT ce."row", ce.col, v, min(k) AS k FROM ce JOIN st ON st.a1 IS NOT NULL AND a0 <= v AND (v < a1 OR a1 = top) GROUP BY ALL)
SELECT "row", col, round(b0 + (v - a0) / (a1 - a0) * (b1 - b0), 6) AS value FROM pk JOIN st USING (k)""")
def _(t, spark, d):
    return rounded(mosaic.quantile_match(surface(spark, d, "O").select("row", "col", "value"), surface(spark, d, "F").select("row", "col", "value")))


_FRAMES = "fr AS (SELECT s_suppkey AS layer, s_acctbal AS west, (s_suppkey * 37 % 1000)::DOUBLE AS south, s_acctbal + 400 AS east, (s_suppkey * 37 % 1000) + 150.0 AS north FROM supplier)"


def _frames(t):
    south = (F.col("s_suppkey") * 37 % 1000).cast("double")
    return t("supplier").select(F.col("s_suppkey").alias("layer"), F.col("s_acctbal").alias("west"), south.alias("south"), (F.col("s_acctbal") + 400).alias("east"), (south + 150).alias("north"))


@query("frame_overlaps", f"WITH {_FRAMES} SELECT a.layer AS a_layer, b.layer AS b_layer, round((least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south)), 4) AS area FROM fr a JOIN fr b ON a.layer < b.layer AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north")
def _(t, spark, d):
    return rounded(mosaic.overlaps(_frames(t)), 4)


@query("frame_bounds", f"WITH {_FRAMES} SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM fr")
def _(t, spark, d):
    return mosaic.union_bounds(_frames(t))


@query("frame_order", f"WITH {_FRAMES}, m AS (SELECT avg((west + east) / 2) AS mx, avg((south + north) / 2) AS my FROM fr) SELECT layer, round({hyp('(west + east) / 2 - mx', '(south + north) / 2 - my')}, 6) AS away FROM fr, m")
def _(t, spark, d):
    return rounded(mosaic.ordered_by_distance(_frames(t)).select("layer", "away"))


@query("report_listing", """WITH r AS (SELECT l_orderkey AS p, (l_discount - 0.05) * 100 AS rx, (l_tax - 0.04) * 100 AS ry, l_quantity - 25 AS rz, CASE l_returnflag WHEN 'R' THEN 'GCP' WHEN 'A' THEN 'Check' ELSE 'TP' END AS k, 's' || l_suppkey AS im, l_extendedprice AS x FROM lineitem)
SELECT printf('%9s%11.3f%11.3f%11.3f%11.3f%6s  %-17s%17.3f%17.3f%17.3f', p::VARCHAR, sqrt(rx * rx + ry * ry), rx, ry, rz, k, im, x, x / 2, x) AS line FROM r""")
def _(t, spark, d):
    r = t("lineitem").select(
        F.col("l_orderkey").alias("point_id"), F.when(F.col("l_returnflag") == "R", "gcp").when(F.col("l_returnflag") == "A", "check").otherwise("tie").alias("kind"), F.concat(F.lit("s"), "l_suppkey").alias("image"),
        ((F.col("l_discount") - 0.05) * 100).alias("res_x"), ((F.col("l_tax") - 0.04) * 100).alias("res_y"), (F.col("l_quantity") - 25).alias("res_z"), F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") / 2).alias("y"), F.col("l_extendedprice").alias("z"),
    )
    return reports.residual_listing(r).select("line")


@query("report_table", """WITH w AS (SELECT greatest(max(length(n_nationkey::VARCHAR)), 2)::INT AS a, greatest(max(length(n_name)), 4)::INT AS b, greatest(max(length(n_regionkey::VARCHAR)), 6)::INT AS c FROM nation)
SELECT 0::BIGINT AS rank, lpad('Id', a, ' ') || ' ' || lpad('Name', b, ' ') || ' ' || lpad('Region', c, ' ') AS line FROM w UNION ALL SELECT 1, repeat('-', a + b + c + 2) FROM w
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) + 1, lpad(n_nationkey::VARCHAR, a, ' ') || ' ' || lpad(n_name, b, ' ') || ' ' || lpad(n_regionkey::VARCHAR, c, ' ') FROM nation, w""")
def _(t, spark, d):
    return reports.table_lines(t("nation"), [("n_nationkey", "Id", None), ("n_name", "Name", None), ("n_regionkey", "Region", None)], ["n_nationkey"])


@query("control_export", "SELECT s_name AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'check' ELSE 'control' END AS type, s_acctbal AS x, s_suppkey::DOUBLE AS y, s_nationkey::DOUBLE AS z FROM supplier")
def _(t, spark, d):
    c = t("supplier").select(F.col("s_name").alias("id"), (F.col("s_nationkey") % 2 == 0).alias("is_check"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"), F.col("s_nationkey").cast("double").alias("z"))
    return reports.control_export(c)


@query("geojson_points", """SELECT '{"type":"Feature","properties":{"s_suppkey":' || s_suppkey || '},"geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ',1]}}' AS feature FROM supplier""")
def _(t, spark, d):
    return reports.point_features(t("supplier").select("s_suppkey", F.col("s_suppkey").alias("x"), F.col("s_nationkey").cast("long").alias("y"), F.lit(1).cast("long").alias("z")), ["s_suppkey"])


@query("crs_round_trip", "SELECT c_custkey, round(31 + c_acctbal / 10000, 6) AS lon, round(-25 + (c_custkey % 100) / 10.0, 6) AS lat FROM customer")
def _(t, spark, d):
    c = t("customer").select("c_custkey", (F.lit(31.0) + F.col("c_acctbal") / 10_000).alias("lon"), (F.lit(-25.0) + (F.col("c_custkey") % 100) / 10.0).alias("lat"))
    for name in ("Lo31 Hart94", "UTM36S", "3857"):
        x, y = cameras.to_crs(F.col("lon"), F.col("lat"), name)
        at = c.select("c_custkey", x.alias("x"), y.alias("y"))
        lon, lat = cameras.from_crs(F.col("x"), F.col("y"), name)
        c = at.select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    return c.select("c_custkey", near("lon", 6).alias("lon"), near("lat", 6).alias("lat"))


@query("neighbourhood_features", None)
def _(t, spark, d):
    p = t("customer").select(F.col("c_custkey").alias("index"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), (F.col("c_nationkey") * 2).cast("double").alias("z"))
    return rounded(features.neighbourhood_features(p, 8, 10.0), 5)


@query("forest_labels", None)
def _(t, spark, d):
    rows = t("lineitem").select(*KEYS, "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") > 30_000).cast("int").alias("class"))
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    model, _ = features.train_forest(rows, "class", columns, trees=8, depth=6)
    return features.apply_forest(model, rows, columns).groupBy("class", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("resection", None)
def _(t, spark, d):
    o = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("image_id"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("gx"), (F.col("c_custkey") * 91 % 1000).cast("double").alias("gy"), (F.col("c_custkey") * 13 % 50).cast("double").alias("gz"))
    from ..functions.geometry import project

    x, y = project([F.col("gx"), F.col("gy"), F.col("gz")], [F.lit(480.0), F.lit(520.0), F.lit(1500.0)], [F.lit(0.02), F.lit(-0.03), F.lit(0.4)], F.lit(153.0))
    return rounded(fits.resection(o.select("*", x.alias("x_mm"), y.alias("y_mm")), 153.0).drop("sigmas", "rms_mm"), 4)


@query("spaced_choice", None)
def _(t, spark, d):
    p = t("lineitem").select((F.col("l_orderkey") % 16).alias("tile"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1000).alias("y"), F.col("l_discount").alias("score"))
    return features.spaced(p, "tile", "score", 8000.0, 20)


@query("surface_offsets", f'WITH {_LAYERS} SELECT a.layer AS i, b.layer AS j, round(median(b.value - a.value), 6) AS d, count(*) AS n FROM s a JOIN s b ON a."row" = b."row" AND a.col = b.col AND a.layer < b.layer GROUP BY ALL')
def _(t, spark, d):
    s = _layers(spark, d)
    a, b = (s.select("row", "col", F.col("layer").alias(k), F.col("value").alias(f"v{k}")) for k in "ij")
    return rounded(middle(a.join(b, ["row", "col"]).filter("i < j"), F.col("vj") - F.col("vi"), ["i", "j"], "d"))


_CUTS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


@query("price_quantiles", f"""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, unnest({_CUTS}) AS share,
round(unnest(quantile_cont(l_extendedprice, {_CUTS})), 6) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t, spark, d):
    by = ["l_returnflag", "l_linestatus"]
    q = exact_quantiles(t("lineitem"), "l_extendedprice", _CUTS, by)
    pair = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in _CUTS]).alias("share"), F.col("q").alias("value")))
    return rounded(q.select(*by, "n", pair.alias("z")).select(*by, "n", "z.share", "z.value"))


@query("surface_hull", f"WITH {SURFACE} SELECT min(\"row\") AS r0, max(\"row\") AS r1, min(col) AS c0, max(col) AS c1 FROM s")
def _(t, spark, d):
    return surface(spark, d).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


@query("knn_vectors", "WITH d AS (SELECT a.vec_id AS q, b.vec_id AS p, a.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d2 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT q, arg_min(p, row(d2, p)) AS p FROM d GROUP BY q")
def _(t, spark, d):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("block"))
    return neighbours.nearest_vectors(e)


# ---- block diagnostics -------------------------------------------------------------------------

@query("class_names", "SELECT DISTINCT l_linenumber, CASE l_linenumber WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 3 THEN 'Low vegetation' WHEN 4 THEN 'Medium vegetation' WHEN 5 THEN 'High vegetation' WHEN 6 THEN 'Building' WHEN 7 THEN 'Low noise' END AS name FROM lineitem")
def _(t, spark, d):
    return t("lineitem").select("l_linenumber").distinct().select("l_linenumber", diagnostics.class_name(F.col("l_linenumber")).alias("name"))


@query("colour_ramp", "SELECT c_custkey, floor(CASE WHEN v <= 0.5 THEN v / 0.5 * 255 ELSE 255 END + 0.5)::INT AS r, floor(CASE WHEN v <= 0.5 THEN v / 0.5 * 128 ELSE 128 + (v - 0.5) / 0.5 * -128 END + 0.5)::INT AS g FROM (SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 10007)) AS v FROM customer)")
def _(t, spark, d):
    ramp = diagnostics.colour_ramp(F.col("c_acctbal") / 10_007, [(0.0, (0, 0, 0)), (0.5, (255, 128, 0)), (1.0, (255, 0, 0))])
    return t("customer").select("c_custkey", ramp.alias("c")).select("c_custkey", "c.r", "c.g")


@query("depth_band", "SELECT o_orderkey FROM orders, (SELECT median(o_totalprice) AS m FROM orders) WHERE o_totalprice > 0.45 * m AND o_totalprice < 2.2 * m")
def _(t, spark, d):
    return diagnostics.depth_band(t("orders"), "o_totalprice").select("o_orderkey")


@query("stride_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, greatest(1, count(*) OVER () // 300) AS step FROM orders) WHERE r % step = 0")
def _(t, spark, d):
    return diagnostics.every(t("orders"), ["o_orderkey"], 300).select("o_orderkey")


@query("readiness", """WITH n AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer), u AS (SELECT count(*) FILTER (s_suppkey % 2 = 1) AS c, count(*) FILTER (s_suppkey % 2 = 0) AS k FROM supplier WHERE s_suppkey IN (SELECT o_orderkey % 50 FROM orders))
SELECT * FROM (SELECT 'blocker' AS level, 'starved_photos' AS code, count(*) FILTER (n < 3) AS n FROM n UNION ALL SELECT 'warning', 'thin_photos', count(*) FILTER (n BETWEEN 3 AND 5) FROM n) WHERE n > 0 UNION ALL SELECT 'blocker', 'control', c FROM u WHERE c < 3 UNION ALL SELECT 'warning', 'no_checks', k FROM u WHERE k = 0""")
def _(t, spark, d):
    obs = t("orders").select(F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 50).alias("point_id"))
    return diagnostics.readiness(t("customer").select(F.col("c_custkey").alias("image_id")), obs, t("supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 2 == 0).alias("is_check")))


@query("tie_summary", "WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS tracks, count(*) FILTER (n >= 3) AS multi_ray, round(avg(n), 6) AS mean_rays, max(n) AS most_rays FROM n")
def _(t, spark, d):
    return rounded(diagnostics.tie_summary(t("lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))))


@query("jobs_listing", "SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def _(t, spark, d):
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))
    return diagnostics.jobs_listing(jobs, 200).select("job_id")


@query("accept_control", """WITH e AS (SELECT s_suppkey AS point_id, s_acctbal / 100 AS ex, (s_suppkey % 10)::DOUBLE AS ey, s_nationkey AS im FROM supplier), p AS (SELECT c_custkey, c_nationkey AS im, c_acctbal / 100 AS x, (c_custkey % 10)::DOUBLE AS y FROM customer)
SELECT p.c_custkey, min(e.point_id) AS point_id FROM p LEFT JOIN e ON sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) <= 1.5 AND e.im <> p.im GROUP BY p.c_custkey""")
def _(t, spark, d):
    e = t("supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"), F.col("s_nationkey").alias("image_id"))
    p = t("customer").select("c_custkey", F.col("c_nationkey").alias("image_id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"), F.col("c_custkey").cast("double").alias("z"))
    return diagnostics.accept_control(p, e).select("c_custkey", "point_id")


@query("scene_crop", "SELECT c_custkey, round(2 * -y + 5, 6) AS x, round(2 * x - 1, 6) AS y FROM (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer) WHERE 2 * -y + 5 BETWEEN -40 AND 5 AND 2 * x - 1 BETWEEN 0 AND 100")
def _(t, spark, d):
    p = t("customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    moved = diagnostics.similarity_3d(p, 2.0, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [5.0, -1.0, 0.0])
    return rounded(diagnostics.crop(moved, (-40.0, 0.0, -1.0, 5.0, 100.0, 1.0)).select("c_custkey", "x", "y"))


@query("distortion_verdict", "SELECT p_partkey, CASE WHEN p_size / 20.0 < 0.5 THEN 'good' WHEN p_size / 20.0 < 2 THEN 'check' ELSE 'suspect' END AS verdict FROM part")
def _(t, spark, d):
    return t("part").select("p_partkey", diagnostics.distortion_verdict(F.col("p_size") / 20.0).alias("verdict"))


@query("pixel_centres", "SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE -0.5 END, 4) AS col FROM orders")
def _(t, spark, d):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("col"), F.lit(0.0).alias("row"), (F.col("o_orderkey") % 2 == 0).alias("automatic"), F.lit(2.0).alias("scale"))
    return diagnostics.pixel_centres(o, 3).select("o_orderkey", near("col", 4).alias("col"))


@query("self_calibration", """WITH q AS (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey * 4.0 - 50 AS y FROM customer), n AS (SELECT *, x / 100 AS a, y / 100 AS b, (x * x + y * y) / 10000 AS r2 FROM q)
SELECT c_custkey, round(0.01 + x * (0.02 / 150 + 0.003 * r2 - 0.001 * r2 * r2) + 100 * (0.0005 * (3 * a * a + b * b) + 2 * -0.0002 * a * b) + 0.0001 * x, 6) AS dx,
round(-0.02 + y * (0.02 / 150 + 0.003 * r2 - 0.001 * r2 * r2) + 100 * (-0.0002 * (a * a + 3 * b * b) + 2 * 0.0005 * a * b), 6) AS dy FROM n""")
def _(t, spark, d):
    from ..functions.geometry import self_calibration

    lens = {"dx0": 0.01, "dy0": -0.02, "df": 0.02, "k1": 0.003, "k2": -0.001, "p1": 0.0005, "p2": -0.0002, "b1": 0.0001}
    dx, dy = self_calibration(F.col("c_acctbal") / 100, F.col("c_nationkey") * 4.0 - 50, lens, 150.0, 100.0)
    return rounded(t("customer").select("c_custkey", dx.alias("dx"), dy.alias("dy")))


# ---- depth maps, voxels, precision -------------------------------------------------------------

_DEPTHS = "dp AS (SELECT l_suppkey AS image_id, l_partkey % 20 AS \"row\", l_orderkey % 20 AS col, 100 + l_discount * 20 AS depth FROM lineitem)"


@query("depth_consensus", f"""WITH {_DEPTHS}, m AS (SELECT image_id, "row", col, median(depth) AS mid FROM dp GROUP BY ALL),
k AS (SELECT dp.* FROM dp JOIN m USING (image_id, "row", col) WHERE abs(depth - mid) <= 0.003 * mid) SELECT image_id, "row", col, round(avg(depth), 6) AS depth, count(*) AS agree FROM k GROUP BY ALL HAVING avg(depth) BETWEEN 100.17 AND 101.87""")
def _(t, spark, d):
    seen = t("lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 20).alias("row"), (F.col("l_orderkey") % 20).alias("col"), (100 + F.col("l_discount") * 20).alias("depth"))
    bounds = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(100.17).alias("near"), F.lit(101.87).alias("far"))
    return rounded(volumes.depth_consensus(seen, 0.003, bounds))


_SEEN = "sn AS (SELECT l_partkey % 500 AS voxel, (l_quantity - 20) / 10 AS sdf, l_tax * 1000 AS red FROM lineitem)"


@query("fused_distances", f"WITH {_SEEN} SELECT voxel, round(avg(greatest(-1, least(1, sdf / 1.5))), 6) AS value, count(*) AS weight, round(avg(red) FILTER (abs(sdf) < 1.5), 6) AS red FROM sn WHERE sdf > -1.5 GROUP BY voxel")
def _(t, spark, d):
    seen = t("lineitem").select((F.col("l_partkey") % 500).alias("voxel"), ((F.col("l_quantity") - 20) / 10).alias("sdf"), (F.col("l_tax") * 1000).alias("red"))
    return rounded(volumes.fuse_distances(seen, 1.5, ["red"]))


_FUSED = "fu AS (SELECT (c_custkey % 7)::INT AS ix, (c_custkey // 7 % 11)::INT AS iy, (c_custkey // 77)::INT AS iz, c_acctbal AS value, 1 AS weight FROM customer)"


@query("surface_voxels", f"""WITH {_FUSED}, cr AS (
SELECT f.ix + 0.5 + f.value / (f.value - g.value) AS x, f.iy + 0.5 AS y, f.iz + 0.5 AS z FROM fu f JOIN fu g ON g.ix = f.ix + 1 AND g.iy = f.iy AND g.iz = f.iz WHERE (f.value < 0) <> (g.value < 0) UNION ALL
SELECT f.ix + 0.5, f.iy + 0.5 + f.value / (f.value - g.value), f.iz + 0.5 FROM fu f JOIN fu g ON g.ix = f.ix AND g.iy = f.iy + 1 AND g.iz = f.iz WHERE (f.value < 0) <> (g.value < 0) UNION ALL
SELECT f.ix + 0.5, f.iy + 0.5, f.iz + 0.5 + f.value / (f.value - g.value) FROM fu f JOIN fu g ON g.ix = f.ix AND g.iy = f.iy AND g.iz = f.iz + 1 WHERE (f.value < 0) <> (g.value < 0))
SELECT round(x * 2.0, 6) AS x, round(y * 2.0, 6) AS y, round(z * 2.0, 6) AS z FROM cr""")
def _(t, spark, d):
    return rounded(volumes.surface_voxels(_fused(t), 2.0))


def _fused(t):
    key = F.col("c_custkey")
    place = [(key % 7).cast("int").alias("ix"), (F.floor(key / 7) % 11).cast("int").alias("iy"), F.floor(key / 77).cast("int").alias("iz")]
    return t("customer").select(*place, F.col("c_acctbal").alias("value"), F.lit(1).alias("weight"))


_LINE = "ln AS (SELECT p_partkey, p_retailprice / 100 AS x, p_size + 0.3 * p_retailprice / 100 AS y FROM part), ss AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(y * y) - count(*) * avg(y) * avg(y) AS syy FROM ln), li AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS s0 FROM ss)"


def _line(t):
    x = F.col("p_retailprice") / 100
    return t("part").select("p_partkey", x.alias("x"), (F.col("p_size") + 0.3 * x).alias("y"))


@query("fit_precision", f"WITH {_LINE} SELECT round(a, 5) AS a, round(b, 5) AS b, round(s0, 5) AS sigma0, round(s0 * sqrt(1.0 / n + mx * mx / sxx), 5) AS sigma_a, round(s0 / sqrt(sxx), 5) AS sigma_b, (n - 2)::BIGINT AS redundancy FROM li")
def _(t, spark, d):
    p = fits.precision(_line(t), [F.lit(1.0), F.col("x")], F.col("y"))
    values = [*p["x"], p["sigma0"], p["covariance"][0, 0] ** 0.5, p["covariance"][1, 1] ** 0.5]
    return rounded(spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in zip(("a", "b", "sigma0", "sigma_a", "sigma_b"), values, strict=True)], F.lit(int(p["redundancy"])).cast("long").alias("redundancy")), 5)


@query("redundancy_numbers", f"WITH {_LINE}, rd AS (SELECT p_partkey, y - a - b * x AS v, 1 - 1.0 / n - (x - mx) * (x - mx) / sxx AS r, s0 FROM ln, li) SELECT p_partkey, round(v, 5) AS residual, round(r, 6) AS redundancy, round(v / (s0 * sqrt(r)), 5) AS w FROM rd")
def _(t, spark, d):
    c = fits.checked(_line(t), [F.lit(1.0), F.col("x")], F.col("y"))
    return c.select("p_partkey", near("residual", 5).alias("residual"), near("redundancy", 6).alias("redundancy"), near("w", 5).alias("w"))


# ---- certificates and alignment ----------------------------------------------------------------

@query("word_rows", """WITH w AS (SELECT n_regionkey::INT AS page, n_name AS word, n_nationkey % 4 AS r, n_nationkey AS x FROM nation),
d AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS "row" FROM w) SELECT page, "row"::INT AS "row", string_agg(word, ' ' ORDER BY x) AS line FROM d GROUP BY page, "row" """)
def _(t, spark, d):
    k = F.col("n_nationkey")
    top = (k % 4) * 20 + (k % 3) * 0.5
    words = t("nation").select(F.col("n_regionkey").cast("int").alias("page"), F.col("n_name").alias("text"), k.cast("double").alias("x0"), top.alias("y0"), (k + 1.0).alias("x1"), (top + 10).alias("y1"))
    return diagnostics.word_rows(words)


@query("certificate_fields", """SELECT s_suppkey::INT AS page, (150 + s_nationkey) || ',' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS focal_mm, '-0.0' || s_nationkey AS ppa_x_mm, 'UAG-' || s_suppkey AS serial FROM supplier""")
def _(t, spark, d):
    s = t("supplier")
    lines = F.array(
        F.lit("Report of calibration"),
        F.concat(F.lit("Lens No. UAG-"), F.col("s_suppkey")),
        F.concat(F.lit("Calibrated Focal Length: "), F.col("s_nationkey") + 150, F.lit(","), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit(" mm")),
        F.concat(F.lit("Principal Point of Autocollimation: -0.0"), F.col("s_nationkey"), F.lit(" mm")),
        F.lit("Focal length 999.9 of another lens"),
    )
    return diagnostics.certificate_fields(s.select(F.col("s_suppkey").cast("int").alias("page"), F.posexplode(lines).alias("row", "line")))


@query("raster_alignment", f"""WITH {FULL}, fl AS (SELECT * FROM f), gr AS (SELECT r * 100 + c AS id, 900.0 + c * 2300.0 AS x, 3.0 + r * 4.5 AS y FROM (SELECT unnest(range(10)) AS r), (SELECT unnest(range(45)) AS c)),
fr AS (SELECT id, x / 1000.0 - 0.5 AS fx, ({GRID.north} - y) / 5.0 - 0.5 AS fy FROM gr), {_CORNERS.format(key="id", at="fr")} SELECT id, round(ground, 6) AS value FROM el""")
def _(t, spark, d):
    rows = spark.range(10).select(F.col("id").alias("r")).crossJoin(F.broadcast(spark.range(45).select(F.col("id").alias("c"))))  # a grid of fixed size
    centres = rows.select((F.col("r") * 100 + F.col("c")).alias("id"), (900.0 + F.col("c") * 2300.0).alias("x"), (3.0 + F.col("r") * 4.5).alias("y"))
    return rounded(stencils.bilinear(full_surface(spark, d), centres, 0.0, GRID.north, 1000.0, 5.0, "id"))


# ---- triangulated surfaces ---------------------------------------------------------------------
# Suppliers as a sparse cloud: x balance, y their number folded. The SQL tries all triangles of all points: one belongs to the mesh if no point lies in its circle

_CLOUD = "cl AS (SELECT s_acctbal AS x, (s_suppkey * 7919 % 10007)::DOUBLE AS y, s_nationkey * 1.0 AS z FROM supplier)"


def _mesh_sql(layered: str) -> str:
    """CTEs ``p`` (distinct points of the relation ``layered``) and ``tri``, its triangles."""
    d = {k: f"({k}.x - d.x)" for k in "abc"} | {k.upper(): f"({k}.y - d.y)" for k in "abc"}
    square = {k: f"({d[k]} * {d[k]} + {d[k.upper()]} * {d[k.upper()]})" for k in "abc"}
    circle = " + ".join(f"{square[i]} * ({d[j]} * {d[k.upper()]} - {d[k]} * {d[j.upper()]})" for i, j, k in ("abc", "bca", "cab"))
    return f"""p AS (SELECT layer, x, y, max(z) AS z, row_number() OVER (PARTITION BY layer ORDER BY x, y) AS k FROM {layered} GROUP BY layer, x, y),
tri AS (SELECT a.layer, a.x AS xa, a.y AS ya, a.z AS za, b.x AS xb, b.y AS yb, b.z AS zb, c.x AS xc, c.y AS yc, c.z AS zc
FROM p a JOIN p b ON b.layer = a.layer AND b.k > a.k JOIN p c ON c.layer = a.layer AND c.k > a.k AND c.k <> b.k
WHERE (b.x - a.x) * (c.y - a.y) > (b.y - a.y) * (c.x - a.x) AND NOT EXISTS (SELECT 1 FROM p d WHERE d.layer = a.layer AND d.k <> a.k AND d.k <> b.k AND d.k <> c.k AND {circle} > 0))"""


_TIN = grid.Grid(-1000.0, 10_000.0, 500.0, 500.0, 22, 20)
_D = "((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa))"
_ON_CELLS = f"""ce AS (SELECT r AS "row", c AS col, {_TIN.west} + (c + 0.5) * {_TIN.cell_x} AS px, {_TIN.north} - (r + 0.5) * {_TIN.cell_y} AS py
FROM (SELECT unnest(range({_TIN.rows}))::INT AS r) a, (SELECT unnest(range({_TIN.cols}))::INT AS c) b),
w AS (SELECT "row", col, tri.*, ((px - xa) * (yc - ya) - (py - ya) * (xc - xa)) / {_D} AS wb, ((xb - xa) * (py - ya) - (yb - ya) * (px - xa)) / {_D} AS wc FROM tri, ce),
su AS (SELECT layer, "row", col, max(za + wb * (zb - za) + wc * (zc - za)) AS value,
max(greatest(hypot_(xa - xb, ya - yb), hypot_(xb - xc, yb - yc), hypot_(xc - xa, yc - ya))) AS edge FROM w WHERE wb >= 0 AND wc >= 0 AND wb + wc <= 1 GROUP BY layer, "row", col)"""
_ON_CELLS = re.sub(r"hypot_\((.*?), (.*?)\)", r"sqrt((\1) * (\1) + (\2) * (\2))", _ON_CELLS)
_RUNGS = [0.0, 5.0, 10.0, 15.0, 20.0]
_HALF = f"""ha AS (SELECT max(row(z, x, y)) AS m FROM cl GROUP BY trunc(({_TIN.north} - y) / {_TIN.cell_y / 2}), trunc((x - {_TIN.west}) / {_TIN.cell_x / 2})),
la AS (SELECT k::INT AS layer, m[2] AS x, m[3] AS y, m[1] AS z FROM ha, (SELECT unnest(range({len(_RUNGS)})) AS k, unnest({_RUNGS}) AS t) WHERE k = 0 OR (m[1] >= t AND t < (SELECT max(z) FROM cl)))"""


def _cloud(t):
    return t("supplier").select(F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7919 % 10007).cast("double").alias("y"), (F.col("s_nationkey") * 1.0).alias("z"))


@query("tin_triangles", f"WITH {_CLOUD}, la AS (SELECT 0 AS layer, * FROM cl), {_mesh_sql('la')} SELECT * EXCLUDE (layer) FROM tri")
def _(t, spark, d):
    return delaunay(_cloud(t)).drop("layer")


@query("tin_surface", f'WITH {_CLOUD}, la AS (SELECT 0 AS layer, * FROM cl), {_mesh_sql("la")}, {_ON_CELLS} SELECT "row", col, round(value, 5) AS value FROM su WHERE edge <= 3000')
def _(t, spark, d):
    return rounded(tin_grid(_cloud(t), _TIN, 3000.0).select("row", "col", "value"), 5)


@query("pit_free_heights", f"""WITH {_CLOUD}, {_HALF}, {_mesh_sql("la")}, {_ON_CELLS},
oc AS (SELECT DISTINCT trunc(({_TIN.north} - y) / {_TIN.cell_y})::INT AS r, trunc((x - {_TIN.west}) / {_TIN.cell_x})::INT AS c FROM cl)
SELECT "row", col, round(max(value), 5) AS value FROM su WHERE (layer = 0 OR edge <= 3000) AND EXISTS (SELECT 1 FROM oc WHERE abs(r - "row") + abs(c - col) <= 3) GROUP BY "row", col""")
def _(t, spark, d):
    return rounded(pit_free(_cloud(t), _TIN, max_edge=3000.0, reach=3, thresholds=_RUNGS[1:]), 5)


# ---- meshes and seams --------------------------------------------------------------------------

_CUBES = " JOIN ".join(["fu c0"] + [f"fu c{k} ON c{k}.ix = c0.ix + {k & 1} AND c{k}.iy = c0.iy + {k >> 1 & 1} AND c{k}.iz = c0.iz + {k >> 2 & 1}" for k in range(1, 8)])
_EDGES = sorted({tuple(sorted((t[i], t[j]))) for t in meshes.TETRAHEDRA for i in range(4) for j in range(i)})
_MESH = f"""{_FUSED}, cu AS (SELECT c0.ix, c0.iy, c0.iz, [{", ".join(f"c{k}.value" for k in range(8))}] AS v FROM {_CUBES}),
te AS (SELECT iz, unnest([{", ".join("[" + ", ".join(f"v[{k + 1}]" for k in t) + "]" for t in meshes.TETRAHEDRA)}]) AS w FROM cu),
tr AS (SELECT iz, sum(CASE len(list_filter(w, lambda x: x < 0)) WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END)::BIGINT AS triangles FROM te GROUP BY iz),
ed AS (SELECT ix, iy, iz, unnest([{", ".join(f"row({i}, {j}, v[{i + 1}], v[{j + 1}])" for i, j in _EDGES)}]) AS e FROM cu),
ve AS (SELECT DISTINCT iz, ix + (e[1] & 1) AS x, iy + (e[1] >> 1 & 1) AS y, iz + (e[1] >> 2 & 1) AS z, e[2] & ~e[1] AS d FROM ed WHERE (e[3] < 0) <> (e[4] < 0))"""


@query("mesh_layers", f"WITH {_MESH} SELECT tr.iz, triangles, count(*) AS corners FROM tr JOIN ve USING (iz) GROUP BY tr.iz, triangles")
def _(t, spark, d):
    """Triangles of each layer of cubes, and the distinct lattice edges that their corners lie on."""
    faces = meshes.surface_triangles(_fused(t), 2.0)
    # the cube of a triangle: the least lattice point of its corners, which all corners of one cube share in z or exceed by one
    low = F.least(*[F.floor((F.col(f"z{k}") / 2.0) - 0.5) for k in "abc"])
    high = F.greatest(*[F.ceil((F.col(f"z{k}") / 2.0) - 0.5) for k in "abc"])
    layer = F.when(high - low == 1, low)
    rows = faces.withColumn("iz", layer.cast("int"))
    corners = rows.select("iz", F.explode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("ix", "iy", "iz", "d")]) for k in "abc"])).alias("n"))
    counts = corners.groupBy("iz").agg(F.count_distinct("n").alias("corners"))
    return rows.groupBy("iz").agg(F.count(F.lit(1)).alias("triangles")).join(counts, "iz")


@query("seam_costs", f"""WITH {_LAYERS}, m AS (SELECT "row", col, count(*)::INT AS covered, median(value) AS mid FROM s GROUP BY "row", col),
sp AS (SELECT s."row", s.col, covered, CASE WHEN covered > 1 THEN avg(abs(value - mid)) ELSE 0 END AS spread FROM s JOIN m USING ("row", col) GROUP BY s."row", s.col, covered)
SELECT "row", col, covered, round(1 + 8 * spread / greatest((SELECT median(spread) FROM sp WHERE covered > 1), 1e-6), 6) AS cost FROM sp""")
def _(t, spark, d):
    return rounded(seams.disagreement(_layers(spark, d)))


@query("seam_owners", None)
def _(t, spark, d):
    return rounded(seams.least_difference(_layers(spark, d), 16))


# ---- blocks ------------------------------------------------------------------------------------
# Customers as ground points; a photo for each of 25 places, which sees the customers in its frame. Measurements are the projections with an error that follows from the keys


def _block(t, spark):
    from ..functions.geometry import project

    p = t("customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("point_id"), (F.col("c_custkey") * 7919 % 1009).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 1013).cast("double").alias("y"), (F.col("c_custkey") * 31 % 61).cast("double").alias("z"), "c_custkey"
    )
    k = F.col("n_nationkey").cast("int")
    angle = lambda m: ((k * m % 11) - 5) * 0.004
    photos = t("nation").select(
        F.format_string("n%02d", k).alias("image_id"), (100 + (k % 5) * 200.0).alias("X0"), (100 + F.floor(k / 5) * 200.0).alias("Y0"), F.lit(1000.0).alias("Z0"), angle(3).alias("omega"), angle(5).alias("phi"), (angle(7) * 3).alias("kappa")
    )
    names = block.EXTERIOR
    seen = p.join(photos, (F.abs(F.col("x") - F.col("X0")) < 330) & (F.abs(F.col("y") - F.col("Y0")) < 330))
    u, v = project([F.col("x"), F.col("y"), F.col("z")], [F.col(c) for c in names[:3]], [F.col(c) for c in names[3:]], F.lit(150.0))
    error = lambda m: (F.pmod(F.xxhash64("point_id", "image_id", F.lit(m)), F.lit(1001)) - 500) / 500 * 0.004
    inside = (F.abs("x_mm") < 45) & (F.abs("y_mm") < 45)
    observed = seen.select("image_id", "point_id", (u + error(1)).alias("x_mm"), (v + error(7)).alias("y_mm")).filter(inside)
    control = p.filter("c_custkey % 10 = 0").select("point_id", *[F.col(c).alias(f"g{c}") for c in "xyz"])
    start = photos.select("image_id", *[(F.col(c) + off).alias(c) for c, off in zip(names, (2.0, -1.5, 3.0, 0.002, -0.003, 0.004), strict=True)])
    first = p.select("point_id", F.col("x") + 1.0, F.col("y") - 1.0, F.col("z") + 2.0).toDF("point_id", "x", "y", "z")
    return block.adjust(observed, start, first, control, 150.0, rounds=8, control_sigma=0.05), photos


@query("block_adjustment", "SELECT printf('n%02d', n_nationkey) AS image_id, true AS within, true AS sigma_fits FROM nation")
def _(t, spark, d):
    """Each photo found within a few of its standard errors of where it was, and the error of the measurements recovered."""
    found, photos = _block(t, spark)
    errors = block.photo_precision(found, 45.0, 45.0, 30.0, 0.01)
    fits_ = 0.5 * 0.004 / 3**0.5 < found.sigma0 < 2 * 0.004 / 3**0.5
    rows = [(i, *map(float, v)) for i, v in zip(found.images, found.exterior, strict=True)]
    solved = spark.createDataFrame(rows, "image_id string, " + ", ".join(f"s_{c} double" for c in block.EXTERIOR))
    off = [F.abs(F.col(f"s_{c}") - F.col(c)) <= 6 * F.get("sigmas", F.lit(k)) + 1e-9 for k, c in enumerate(block.EXTERIOR)]
    within = off[0] & off[1] & off[2] & off[3] & off[4] & off[5]
    return photos.join(solved, "image_id").join(errors, "image_id").select("image_id", within.alias("within"), F.lit(fits_).alias("sigma_fits"))


@query("block_precision", None)
def _(t, spark, d):
    found, _ = _block(t, spark)
    p = block.photo_precision(found, 45.0, 45.0, 30.0, 0.01)
    weak = block.weak_photos(p, 0.05).select("image_id", F.lit(True).alias("weak"))
    return rounded(p.join(weak, "image_id", "left").select("image_id", "corner_m", "corner_px", "pixel_m", F.coalesce("weak", F.lit(False)).alias("weak")), 3)


# ---- datums ------------------------------------------------------------------------------------

_SHIFT = {"source": "Clarke1880", "target": "WGS84", "shift": (-136.0, -108.0, -292.0), "turn": (0.1, -0.2, 0.554), "ppm": 1.5}
_A1, _F1 = geometry.ELLIPSOIDS["Clarke1880"]
_A2, _F2 = geometry.ELLIPSOIDS["WGS84"]
_E1, _E2 = _F1 * (2 - _F1), _F2 * (2 - _F2)
_RX, _RY, _RZ = (math.radians(t / 3600) for t in _SHIFT["turn"])


@query("datum_shift", f"""WITH RECURSIVE p AS (SELECT c_custkey, radians(16 + (c_custkey * 7919 % 1000) / 60.0) AS v, radians(-35 + (c_custkey * 104729 % 1000) / 80.0) AS u, c_acctbal / 10 AS h FROM customer),
n AS (SELECT *, {_A1} / sqrt(1 - {_E1} * sin(u) * sin(u)) AS n FROM p),
g AS (SELECT c_custkey, (n + h) * cos(u) * cos(v) AS x, (n + h) * cos(u) * sin(v) AS y, (n * {1 - _E1} + h) * sin(u) AS z FROM n),
t AS (SELECT c_custkey, {1 + _SHIFT["ppm"] * 1e-6} * (x - {_RZ} * y + {_RY} * z) - 136 AS x, {1 + _SHIFT["ppm"] * 1e-6} * ({_RZ} * x + y - {_RX} * z) - 108 AS y, {1 + _SHIFT["ppm"] * 1e-6} * ({-_RY} * x + {_RX} * y + z) - 292 AS z FROM g),
i AS (SELECT 0 AS k, c_custkey, x, y, z, atan2(z, sqrt(x * x + y * y) * {1 - _E2}) AS u FROM t
  UNION ALL SELECT k + 1, c_custkey, x, y, z, atan2(z + {_E2} * {_A2} / sqrt(1 - {_E2} * sin(u) * sin(u)) * sin(u), sqrt(x * x + y * y)) FROM i WHERE k < 12)
SELECT c_custkey, round(degrees(atan2(y, x)), 9) AS lon, round(degrees(u), 9) AS lat, round(sqrt(x * x + y * y) * cos(u) + z * sin(u) - {_A2} * sqrt(1 - {_E2} * sin(u) * sin(u)), 4) AS height FROM i WHERE k = 12""")
def _(t, spark, d):
    """The SQL goes back to degrees by iteration, the operator by a formula."""
    lon, lat = 16 + (F.col("c_custkey") * 7919 % 1000) / 60.0, -35 + (F.col("c_custkey") * 104729 % 1000) / 80.0
    x, y, h = geometry.datum_shift(lon, lat, F.col("c_acctbal") / 10, **_SHIFT)
    return t("customer").select("c_custkey", near(x, 9).alias("lon"), near(y, 9).alias("lat"), near(h, 4).alias("height"))


@query("scene_levelling", """SELECT c_custkey, round(c_acctbal / 100 - (SELECT quantile_cont(c_acctbal / 100, 0.02) FROM customer), 5) AS height FROM customer""")
def _(t, spark, d):
    """Customers as a scene that was tilted, with a photo for each supplier whose x axis is level: the heights come back."""
    from ..operators.fits import _matrix

    turned = _matrix(0.5, -0.3, 0.9)
    tilt = lambda df: diagnostics.similarity_3d(df, 1.0, turned.tolist(), [10.0, -5.0, 3.0])
    scene = tilt(t("customer").select("c_custkey", (F.col("c_custkey") * 7919 % 1009).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 211).cast("double").alias("y"), (F.col("c_acctbal") / 100).alias("z")))
    heading, pitch = F.col("s_suppkey") * 2.39996, (F.col("s_suppkey") % 7 - 3) * 0.05
    level_rows = [
        [F.sin(heading), -F.cos(heading), F.lit(0.0)],
        [F.sin(pitch) * F.cos(heading), F.sin(pitch) * F.sin(heading), -F.cos(pitch)],
        [F.cos(pitch) * F.cos(heading), F.cos(pitch) * F.sin(heading), F.sin(pitch)],
    ]
    pose = {f"r{i}{j}": sum((float(turned[j][k]) * level_rows[i][k] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)}
    photos = tilt(t("supplier").select((F.col("s_suppkey") * 31 % 997).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 97).cast("double").alias("y"), F.lit(1.5).alias("z"), *[v.alias(k) for k, v in pose.items()]))
    found = levelling.level(photos, scene)
    return diagnostics.similarity_3d(scene, found["scale"], found["rotation"], found["shift"]).select("c_custkey", near("z", 5).alias("height"))


@query("pair_models", """WITH m AS (SELECT (c_nationkey % 3)::VARCHAR AS a, (c_nationkey % 3 + 1)::VARCHAR AS b, c_custkey % 5 <> 0 AS good FROM customer)
SELECT a, b, count(*) AS matches, count(*) FILTER (good) AS inliers, true AS told_apart FROM m GROUP BY a, b""")
def _(t, spark, d):
    """Customers as matches of three image pairs, every fifth of them wrong; the rest lie on a plane."""
    k = F.col("c_custkey")
    x, y = (k * 7919 % 1009).cast("double"), (k * 104729 % 1013).cast("double")
    w = 1 + 1e-4 * x - 2e-4 * y
    wrong = F.when(k % 5 == 0, 60 + (k * 31 % 97)).otherwise(0)
    m = t("customer").select((F.col("c_nationkey") % 3).alias("a"), (F.col("c_nationkey") % 3 + 1).alias("b"), x.alias("xa"), y.alias("ya"), ((1.1 * x + 0.02 * y + 5) / w + wrong).alias("xb"), ((0.95 * y - 0.03 * x - 7) / w - wrong).alias("yb"))
    found = relative.relative_models(m, "plane", 0.5)
    good = F.col("inlier") == (F.abs(F.col("xb") - (1.1 * F.col("xa") + 0.02 * F.col("ya") + 5) / (1 + 1e-4 * F.col("xa") - 2e-4 * F.col("ya"))) < 1)
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("matches"), F.count_if("inlier").alias("inliers"), F.bool_and(good).alias("told_apart"))
