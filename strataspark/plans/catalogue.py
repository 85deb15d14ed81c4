"""Every registered query of the engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import fits, graph, grid, imports, neighbours, residuals, statistics, stencils
from ..operators.ranks import global_rank
from ..session import read_table
from ..streaming import events as S
from .tables import CELLS, FULL, GRID, KEYS, POINTS, RESIDUALS, SURFACE, TWO, full_surface, near, points, rounded, surface
from .tables import residuals as residual_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _nudged(sql: str) -> str:
    """Every ``round(x, n)`` as ``round(x + 1e-9, n)``: means of few decimals lie half-way often, and sums differ in the last bit."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, end = 0, -1, k + 5
        for end in range(k + 5, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if sql[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
        inner = _nudged(sql[k + 6 : comma if comma > 0 else end])
        out += [sql[at : k + 6], inner, f" + 1e-9{sql[comma:end]}" if comma > 0 else ""]
        at = end
    return "".join(out) + sql[at:]


def hyp(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: read_table(spark, sf_dir, t), spark, sf_dir)
        if sql is not None:
            SQL[name] = _nudged(sql)
        return f

    return put


# ---- grids -------------------------------------------------------------------------------------

_NEAR = hyp("x - (0 + (col + 0.5) * 1000.0)", f'y - ({GRID.north} - ("row" + 0.5) * 5.0)')
_WEIGHT = f"(1 / pow(greatest({_NEAR}, 10.0), 2))"
_AGGREGATES = {
    "min": "min(z)", "max": "max(z)", "mean": "avg(z)", "median": "median(z)", "count": "count(z)::DOUBLE", "idw": f"sum(z * {_WEIGHT}) / sum({_WEIGHT})",
    "nearest": f"arg_min(z, row({_NEAR}, l_orderkey, l_linenumber, l_partkey, l_suppkey, z))",
}

for _how, _agg in _AGGREGATES.items():
    @query(f"grid_{_how}", f'WITH {CELLS} SELECT "row", col, round({_agg}, 6) AS value, count(*) AS n FROM c GROUP BY "row", col')
    def _(t, spark, d, how=_how):
        return rounded(grid.grid_aggregate(points(spark, d), GRID, how, order=KEYS))


@query("grid_lattice_coverage", f'WITH {FULL} SELECT count(*) AS cells, count(*) - count(value) AS voids, round(count(value) / count(*), 6) AS coverage FROM f')
def _(t, spark, d):
    return rounded(statistics.raster_statistics(full_surface(spark, d)).select("cells", "voids", "coverage"))


@query("rasterize_ground", f'WITH {CELLS} SELECT "row", col, round(avg(z), 6) AS value, count(*) AS n FROM c WHERE classification = 2 AND return_number = number_of_returns GROUP BY "row", col')
def _(t, spark, d):
    return rounded(grid.grid_aggregate(grid.keep_points(points(spark, d), [2], "last"), GRID, "mean"))


@query("highest_per_cell", f'WITH {CELLS} SELECT "row", col, (m).x AS x, (m).y AS y, (m).z AS z, (m).classification AS classification FROM (SELECT "row", col, arg_max(struct_pack(x := x, y := y, z := z, classification := classification), row(z, -l_orderkey, -l_linenumber, -l_partkey, -l_suppkey, -x)) AS m FROM c GROUP BY "row", col)')
def _(t, spark, d):
    return grid.highest_per_cell(points(spark, d), GRID, [*KEYS, "x"], ["x", "y", "z", "classification"])


@query("voxel_mean", f"""WITH {POINTS} SELECT (((floor(x / 5000)::BIGINT + 1048576) << 42) | ((floor(y / 10)::BIGINT + 1048576) << 21) | (floor(z / 2)::BIGINT + 1048576)) AS voxel,
count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM p GROUP BY 1""")
def _(t, spark, d):
    return grid.voxel_mean(points(spark, d), (5000.0, 10.0, 2.0), ["x", "y", "z"]).select("voxel", "n", near("mean_x", 4).alias("mean_x"), near("mean_y", 6).alias("mean_y"), near("mean_z", 6).alias("mean_z"))


@query("voxel_unpack", f"WITH {POINTS} SELECT DISTINCT floor(x / 5000)::INT AS ix, floor(y / 10)::INT AS iy, floor(z / 2)::INT AS iz FROM p")
def _(t, spark, d):
    v = grid.voxel_mean(points(spark, d), (5000.0, 10.0, 2.0), ["z"])
    return v.select(*[c.alias(n) for c, n in zip(grid.voxel_index(F.col("voxel")), ("ix", "iy", "iz"), strict=True)])


@query("class_histogram", f"WITH {POINTS} SELECT classification, count(*) AS n, min(z) AS low, max(z) AS high FROM p GROUP BY classification")
def _(t, spark, d):
    return points(spark, d).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


for _ret, _test in {"first": "return_number = 1", "last": "return_number = number_of_returns", "single": "number_of_returns = 1"}.items():
    @query(f"returns_{_ret}", f"WITH {POINTS} SELECT l_orderkey, l_linenumber, x, y, z FROM p WHERE {_test} AND classification NOT IN (7, 18)")
    def _(t, spark, d, ret=_ret):
        return grid.keep_points(points(spark, d), returns=ret).select("l_orderkey", "l_linenumber", "x", "y", "z")


@query("cloud_header", f"WITH {POINTS} SELECT count(*) AS n, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north, round(sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)), 6) AS spacing FROM p")
def _(t, spark, d):
    a = points(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"))
    return a.withColumn("spacing", near(F.sqrt((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")) / F.col("n")), 6))


@query("box_scan", f"WITH {POINTS} SELECT l_orderkey, l_linenumber, x, y, z FROM p WHERE x BETWEEN 20000 AND 30000 AND y BETWEEN 10 AND 20")
def _(t, spark, d):
    return points(spark, d).filter(F.col("x").between(20_000, 30_000) & F.col("y").between(10, 20)).select("l_orderkey", "l_linenumber", "x", "y", "z")


@query("tile_halo", f"""WITH {POINTS}, t AS (SELECT *, floor(x / 10000)::BIGINT AS hx, floor(y / 10)::BIGINT AS hy FROM p)
SELECT hx + a AS tx, hy + b AS ty, count(*) AS n, count(*) FILTER (a = 0 AND b = 0) AS core FROM (SELECT x / 1000 AS xs, y, floor(x / 10000)::BIGINT AS hx, floor(y / 10)::BIGINT AS hy FROM p) q,
(SELECT unnest([-1, 0, 1]) AS a) i, (SELECT unnest([-1, 0, 1]) AS b) j
WHERE xs >= (hx + a) * 10 - 2 AND xs < (hx + a + 1) * 10 + 2 AND y >= (hy + b) * 10 - 2 AND y < (hy + b + 1) * 10 + 2 GROUP BY 1, 2""")
def _(t, spark, d):
    p = points(spark, d).withColumn("x", F.col("x") / 1000)
    return neighbours.tile_halo(p, 10.0, 2.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("core"))


@query("section", f"""WITH {POINTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(al, 6) AS along, round(ac, 6) AS across FROM (SELECT *, (x - 1000) * ux + (y - 1) * uy AS al, (y - 1) * ux - (x - 1000) * uy AS ac FROM p,
(SELECT 99000 / sqrt(99000.0 * 99000.0 + 49.0 * 49.0) AS ux, 49 / sqrt(99000.0 * 99000.0 + 49.0 * 49.0) AS uy, sqrt(99000.0 * 99000.0 + 49.0 * 49.0) AS len)) WHERE al BETWEEN 0 AND len AND abs(ac) <= 2""")
def _(t, spark, d):
    return rounded(grid.section(points(spark, d), (1000.0, 1.0), (100_000.0, 50.0), 4.0).select(*KEYS, "along", "across"))


# ---- surfaces ----------------------------------------------------------------------------------

@query("raster_statistics", f"WITH {FULL} SELECT count(*) AS cells, count(*) - count(value) AS voids, round(count(value) / count(*), 6) AS coverage, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median FROM f")
def _(t, spark, d):
    return rounded(statistics.raster_statistics(full_surface(spark, d)))


@query("band_statistics", "SELECT l_linestatus AS band, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.02), 6) AS p2, round(quantile_cont(l_quantity, 0.98), 6) AS p98 FROM lineitem GROUP BY 1")
def _(t, spark, d):
    return rounded(statistics.band_statistics(t("lineitem").select(F.col("l_linestatus").alias("band"), F.col("l_quantity").alias("value"))))


@query("compare_surfaces", f"""WITH {TWO}, j AS (SELECT a.value AS a, b.value AS b, a.value - b.value AS d FROM a JOIN b USING ("row", col)), m AS (SELECT median(d) AS m FROM j)
SELECT count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(max(abs(d)), 6) AS max_abs, round(max(m), 6) AS median, round(1.4826 * median(abs(d - m)), 6) AS nmad,
round(quantile_cont(abs(d), 0.95), 6) AS p95, round(regr_slope(a, b), 6) AS slope, round(regr_intercept(a, b), 6) AS intercept, round(regr_r2(a, b), 6) AS r2 FROM j, m""")
def _(t, spark, d):
    return rounded(statistics.compare_surfaces(surface(spark, d, "O"), surface(spark, d, "F")))


@query("cut_fill", f"""WITH {TWO}, j AS (SELECT a.value - b.value AS d FROM a JOIN b USING ("row", col))
SELECT count(*) AS cells, round(coalesce(sum(d) FILTER (d > 0), 0) * 5000, 3) AS cut, round(coalesce(-sum(d) FILTER (d < 0), 0) * 5000, 3) AS fill, round(sum(d) * 5000, 3) AS net, round(avg(d), 3) AS mean, round(max(d), 3) AS highest, round(max(-d), 3) AS deepest FROM j""")
def _(t, spark, d):
    return rounded(statistics.volume_between(surface(spark, d, "O"), surface(spark, d, "F"), 5000.0), 3)


_UNION = f"""{TWO}, u AS (SELECT *, 0 AS layer FROM a UNION ALL SELECT *, 1 FROM b)"""
for _how, _agg in {"median": "median(value)", "mean": "avg(value)", "first": "arg_min(value, layer)"}.items():
    @query(f"merge_{_how}", f'WITH {_UNION} SELECT "row", col, round({_agg}, 6) AS value, count(*) AS layers FROM u GROUP BY "row", col')
    def _(t, spark, d, how=_how):
        return rounded(statistics.merge([surface(spark, d, "O"), surface(spark, d, "F")], how))


@query("fuse_vote", f"""WITH {_UNION}, s2 AS (SELECT "row", col, avg(z) AS value FROM c GROUP BY ALL), w AS (SELECT * FROM u UNION ALL SELECT "row", col, value, 2 FROM s2),
m AS (SELECT "row", col, median(value) AS m, list(value) AS vs FROM w GROUP BY ALL), k AS (SELECT "row", col, list_filter(vs, lambda v: abs(v - m) <= 0.5) AS near FROM m)
SELECT "row", col, len(near)::INT AS agreeing, round(CASE WHEN len(near) >= 2 THEN list_sum(near) / len(near) END, 6) AS value FROM k""")
def _(t, spark, d):
    return rounded(statistics.fuse_by_vote([surface(spark, d, "O"), surface(spark, d, "F"), surface(spark, d)], 0.5))


@query("voids_clean", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice > 100000 OR l_quantity = 1 THEN NULL ELSE l_extendedprice END AS value FROM lineitem")
def _(t, spark, d):
    raw = F.when(F.col("l_extendedprice") > 100_000, -9999.0).when(F.col("l_quantity") == 1, float("nan")).otherwise(F.col("l_extendedprice"))
    return statistics.clean_elevations(t("lineitem").select(*KEYS, raw.alias("value")))


# ---- stencils ----------------------------------------------------------------------------------

def _neighbour(r: int, c: int) -> str:
    """Value of the neighbour, or of the nearest cell of the lattice at the edge."""
    return f"(SELECT n.value FROM g n WHERE n.\"row\" = greatest(0, least({GRID.rows - 1}, g.\"row\" + {r})) AND n.col = greatest(0, least({GRID.cols - 1}, g.col + {c})))"


_HORN = f"""WITH {FULL}, mu AS (SELECT avg(value) AS m FROM f), g AS (SELECT "row", col, coalesce(value, m) AS value, value IS NULL AS void FROM f, mu),
n AS (SELECT "row", col, void, {", ".join(f"{_neighbour(r, c)} AS {name}" for name, r, c in (("nw", -1, -1), ("nn", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("ss", 1, 0), ("se", 1, 1)))} FROM g),
q AS (SELECT "row", col, void, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * 1000.0) * 100 AS dx, ((nw + 2 * nn + ne) - (sw + 2 * ss + se)) / (8 * 5.0) * 100 AS dy FROM n)
SELECT "row", col, CASE WHEN void THEN 0 ELSE trunc(greatest(0.0, least(1.0, (sin(radians(45)) - cos(radians(45)) * (sin(radians(315)) * dx + cos(radians(315)) * dy)) / sqrt(1 + dx * dx + dy * dy))) * 255)::INT END AS shade FROM q"""


@query("hillshade", _HORN)
def _(t, spark, d):
    return stencils.hillshade(full_surface(spark, d), 1000.0, 5.0, z_factor=100.0)


_ZERO = f"{FULL}, g AS (SELECT \"row\", col, coalesce(value, 0) AS value FROM f)"
_LAT = 'WINDOW h AS (PARTITION BY "row" ORDER BY col), v AS (PARTITION BY col ORDER BY "row")'


def _zero(spark, d):
    return full_surface(spark, d).select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("gradient", f"""WITH {_ZERO} SELECT "row", col, round({hyp("(coalesce(lead(value) OVER h, value) - coalesce(lag(value) OVER h, value)) / (1000.0 * CASE WHEN lag(col) OVER h IS NULL OR lead(col) OVER h IS NULL THEN 1 ELSE 2 END)", "(coalesce(lead(value) OVER v, value) - coalesce(lag(value) OVER v, value)) / (5.0 * CASE WHEN lag(col) OVER v IS NULL OR lead(col) OVER v IS NULL THEN 1 ELSE 2 END)")}, 6) AS slope FROM g {_LAT}""")
def _(t, spark, d):
    return rounded(stencils.gradient(_zero(spark, d), 1000.0, 5.0))


@query("median_filter", f"""WITH {FULL}, o AS (SELECT f."row" + a AS "row", f.col + b AS col, value FROM f, (SELECT unnest([-1, 0, 1]) AS a) i, (SELECT unnest([-1, 0, 1]) AS b) j WHERE value IS NOT NULL),
m AS (SELECT "row", col, median(value) AS m, count(*) AS n FROM o GROUP BY "row", col) SELECT f."row", f.col, round(CASE WHEN n * 3 >= 9 THEN m END, 6) AS value FROM f LEFT JOIN m USING ("row", col)""")
def _(t, spark, d):
    return rounded(stencils.median_filter(full_surface(spark, d), 3))


@query("uniform_filter", f"""WITH {FULL}, h AS (SELECT *, sum(value) OVER w AS s, count(value) OVER w AS k FROM f WINDOW w AS (PARTITION BY "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT *, sum(s) OVER w AS ss, sum(k) OVER w AS kk FROM h WINDOW w AS (PARTITION BY col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT "row", col, round(CASE WHEN value IS NOT NULL THEN ss / kk END, 6) AS value FROM v""")
def _(t, spark, d):
    return rounded(stencils.uniform_filter(full_surface(spark, d), 3))


@query("gaussian_filter", f"""WITH {FULL}, k AS (SELECT unnest(range(-3, 4)) AS o), w AS (SELECT o, exp(-0.5 * pow(o / 1.0, 2)) AS w FROM k),
h AS (SELECT f."row", f.col, sum(w.w * coalesce(g.value, 0)) AS v, sum(w.w * (g.value IS NOT NULL)::INT) AS m FROM f, w LEFT JOIN f g ON g."row" = f."row" AND g.col = f.col + w.o GROUP BY ALL),
x AS (SELECT h."row", h.col, sum(w.w * coalesce(g.v, 0)) AS v, sum(w.w * coalesce(g.m, 0)) AS m FROM h, w LEFT JOIN h g ON g.col = h.col AND g."row" = h."row" + w.o GROUP BY ALL)
SELECT x."row", x.col, round(CASE WHEN f.value IS NOT NULL THEN x.v / x.m END, 5) AS value FROM x JOIN f USING ("row", col)""")
def _(t, spark, d):
    return rounded(stencils.gaussian_filter(full_surface(spark, d), 3), 5)


def _sq(name: str, source: str, r: int, agg: str) -> str:
    return f"""{name}h AS (SELECT "row", col, {agg}(value) OVER (PARTITION BY "row" ORDER BY col ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS value FROM {source}),
{name} AS (SELECT "row", col, {agg}(value) OVER (PARTITION BY col ORDER BY "row" ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS value FROM {name}h)"""


@query("opening_square", f'WITH {_ZERO}, {_sq("e", "g", 2, "min")}, {_sq("o", "e", 2, "max")} SELECT * FROM o')
def _(t, spark, d):
    return stencils.opening_square(_zero(spark, d), 5)


@query("opening_disk", f"""WITH {SURFACE}, k AS (SELECT a, b FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS a) i, (SELECT unnest([-2, -1, 0, 1, 2]) AS b) j WHERE a * a + b * b <= 4),
e AS (SELECT s."row", s.col, min(n.value) AS value FROM s, k JOIN s n ON n."row" = s."row" + k.a AND n.col = s.col + k.b GROUP BY ALL),
o AS (SELECT e."row", e.col, max(n.value) AS value FROM e, k JOIN e n ON n."row" = e."row" + k.a AND n.col = e.col + k.b GROUP BY ALL) SELECT "row", col, round(value, 6) AS value FROM o""")
def _(t, spark, d):
    return rounded(stencils.opening_disk(surface(spark, d), 2))


@query("bare_earth", f"""WITH {_ZERO}, {_sq("e1", "g", 1, "min")}, {_sq("o1", "e1", 1, "max")}, {_sq("e2", "o1", 3, "min")}, {_sq("o2", "e2", 3, "max")}
SELECT g."row", g.col, g.value, g.value - o1.value <= 1.3 AND o1.value - o2.value <= 2.1 AS ground FROM g JOIN o1 USING ("row", col) JOIN o2 USING ("row", col)""")
def _(t, spark, d):
    return stencils.bare_earth(_zero(spark, d), 1.0, most=7)


@query("wallis", f"""WITH {_ZERO}, h AS (SELECT *, sum(value) OVER w AS s, sum(value * value) OVER w AS q, count(value) OVER w AS k FROM g WINDOW w AS (PARTITION BY "row" ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
v AS (SELECT *, sum(s) OVER w AS ss, sum(q) OVER w AS qq, sum(k) OVER w AS kk FROM h WINDOW w AS (PARTITION BY col ORDER BY "row" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT "row", col, round((value - ss / kk) * greatest(0.3, least(4.0, 60.0 / greatest(sqrt(greatest(qq / kk - (ss / kk) * (ss / kk), 0.0)), 1e-6))) + 127, 4) AS value FROM v""")
def _(t, spark, d):
    return rounded(stencils.wallis(_zero(spark, d), 5), 4)


@query("coarsen", f'WITH {SURFACE} SELECT ("row" // 2)::INT AS "row", (col // 2)::INT AS col, round(avg(value), 6) AS value FROM s GROUP BY 1, 2')
def _(t, spark, d):
    return rounded(stencils.coarsen(surface(spark, d), 2))


@query("equalise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((SELECT count(*) FROM q WHERE q.v < l.l_quantity) * 255.0 / (SELECT count(*) - 1 FROM lineitem))::INT AS value FROM lineitem l".replace("(SELECT count(*) FROM q WHERE q.v < l.l_quantity)", "(rank() OVER (ORDER BY l_quantity) - 1)"))
def _(t, spark, d):
    li = t("lineitem")
    # values are few next to rows: ranks come from counts of values, not from a sort of all rows in one task
    counts = global_running(li.groupBy(F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n")), "q", "n")
    total = counts.agg((F.sum("n") - 1).alias("last"))
    return li.join(counts, li["l_quantity"] == counts["q"]).crossJoin(F.broadcast(total)).select(*KEYS, F.floor(F.col("before") * 255.0 / F.col("last")).cast("int").alias("value"))


def global_running(counts: DataFrame, value: str, n: str) -> DataFrame:
    """``before``: the sum of ``n`` over smaller values, by range partitions and one total a partition."""
    from pyspark.sql import Window

    from ..session import materialise

    parts = materialise(counts.repartitionByRange(value).withColumn("__p", F.spark_partition_id()), "running")
    sums = {r["__p"]: r["s"] for r in parts.groupBy("__p").agg(F.sum(n).alias("s")).collect()}
    base, at = [], 0
    for p in range(max(sums, default=-1) + 1):
        base.append(at)
        at += sums.get(p, 0)
    own = F.coalesce(F.sum(n).over(Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("before", own + F.get(F.array(*[F.lit(b).cast("long") for b in base or [0]]), F.col("__p"))).drop("__p")


for _mode, (_lo, _hi) in {"linear": ("min(value)", "max(value)"), "linear2pct": ("quantile_cont(value, 0.02)", "quantile_cont(value, 0.98)"), "stddev": ("avg(value) - 2 * stddev_pop(value)", "avg(value) + 2 * stddev_pop(value)"), "root": ("min(value)", "max(value)")}.items():
    @query(f"stretch_{_mode}", f'WITH {SURFACE}, r AS (SELECT "row", col, round(value, 6) AS value FROM s), b AS (SELECT {_lo} AS lo, {_hi} AS hi FROM r) SELECT "row", col, floor({"sqrt" if _mode == "root" else ""}(greatest(0.0, least(1.0, (value - lo) / greatest(hi - lo, 1e-12)))) * 255 + 1e-6)::INT AS value FROM r, b')
    def _(t, spark, d, mode=_mode):
        s = surface(spark, d).select("row", "col", near("value", 6).alias("value"))
        stats = stencils.stretch(s, mode)
        return stats


_BIL = f"""WITH {FULL}, q AS (SELECT c_custkey, 50000 + c_acctbal * 5 AS x, 1.0 + (c_custkey % 48) AS y FROM customer),
a AS (SELECT c_custkey, x / 1000.0 - 0.5 AS fx, ({GRID.north} - y) / 5.0 - 0.5 AS fy FROM q), b AS (SELECT *, floor(fx)::INT AS c0, floor(fy)::INT AS r0 FROM a),
k AS (SELECT c_custkey, r0 + i.a AS "row", c0 + j.b AS col, (CASE i.a WHEN 1 THEN fy - r0 ELSE 1 - (fy - r0) END) * (CASE j.b WHEN 1 THEN fx - c0 ELSE 1 - (fx - c0) END) AS w FROM b, (SELECT unnest([0, 1]) AS a) i, (SELECT unnest([0, 1]) AS b) j)
SELECT k.c_custkey, CASE WHEN count(*) FILTER (f.value IS NULL) = 0 THEN round(sum(w * f.value), 5) END AS value FROM k LEFT JOIN f USING ("row", col) WHERE w > 0 GROUP BY k.c_custkey"""


@query("bilinear_sample", _BIL)
def _(t, spark, d):
    c = t("customer").select("c_custkey", (50_000 + F.col("c_acctbal") * 5).alias("x"), (F.lit(1.0) + F.col("c_custkey") % 48).alias("y"))
    return rounded(stencils.bilinear(full_surface(spark, d), c, 0.0, GRID.north, 1000.0, 5.0, "c_custkey"), 5)


# ---- neighbours and graphs ---------------------------------------------------------------------

_CUST = "q AS (SELECT c_custkey AS index, c_acctbal / 100 AS x, (c_custkey % 97)::DOUBLE AS y, (c_nationkey * 2)::DOUBLE AS z FROM customer)"


def _customers(t):
    return t("customer").select(F.col("c_custkey").alias("index"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), (F.col("c_nationkey") * 2).cast("double").alias("z"))


@query("knn", f"""WITH {_CUST}, d AS (SELECT a.index AS q, b.index AS p, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM q a JOIN q b ON a.index <> b.index),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM d) SELECT q, p, round(sqrt(d2), 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 4""")
def _(t, spark, d):
    return rounded(neighbours.nearest(_customers(t), 4, 8.0))


@query("radius_count", f"""WITH {_CUST} SELECT a.index, count(b.index) AS n FROM q a LEFT JOIN q b ON a.index <> b.index AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 64 GROUP BY a.index""")
def _(t, spark, d):
    return neighbours.radius_count(_customers(t), 8.0)


@query("statistical_noise", f"""WITH {_CUST}, d AS (SELECT a.index, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.index AS p FROM q a JOIN q b ON a.index <> b.index),
r AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY d2, p) AS k FROM d), m AS (SELECT index, avg(sqrt(d2)) AS m FROM r WHERE k <= 4 GROUP BY index), s AS (SELECT avg(m) + 2.5 * stddev_pop(m) AS lim FROM m)
SELECT index, round(m, 6) AS mean_distance, m > lim AS noise FROM m, s""")
def _(t, spark, d):
    return rounded(neighbours.statistical_noise(_customers(t), 4, 8.0))


@query("isolated_noise", f"""WITH {_CUST}, c AS (SELECT a.index, count(b.index) AS n FROM q a LEFT JOIN q b ON a.index <> b.index AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 64 GROUP BY a.index)
SELECT index, n, n < 3 AS noise FROM c""")
def _(t, spark, d):
    return neighbours.isolated_noise(_customers(t), 8.0)


@query("ratio_match", """WITH l AS (SELECT vec_id AS a, embedding AS v, label FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT vec_id AS b, embedding AS v, label FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT a, b, list_sum(list_transform(list_zip(l.v, r.v), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d2 FROM l JOIN r USING (label)),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS k FROM d), t AS (SELECT a, arg_min(b, k) AS b, min(d2) AS d2, max(d2) FILTER (k = 2) AS second FROM n WHERE k <= 2 GROUP BY a),
m AS (SELECT b, arg_min(a, row(d2, a)) AS a FROM d GROUP BY b) SELECT t.a, t.b, round(sqrt(t.d2), 4) AS distance FROM t JOIN m ON t.a = m.a AND t.b = m.b WHERE second IS NULL OR sqrt(t.d2) < 0.95 * sqrt(second)""")
def _(t, spark, d):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("block"))
    return rounded(neighbours.ratio_match(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 0.95), 4)


_PAIRS = """r AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem), c AS (SELECT x.i AS a, y.i AS b, count(*) AS shared FROM r x JOIN r y ON x.g = y.g AND x.i < y.i GROUP BY ALL)"""


@query("co_occurrence", f"WITH {_PAIRS} SELECT * FROM c WHERE shared >= 2")
def _(t, spark, d):
    return neighbours.co_occurrence(t("lineitem"), "l_suppkey", "l_orderkey", 2)


@query("pair_top_k", f"""WITH {_PAIRS}, s AS (SELECT a, b, shared AS score FROM c), u AS (SELECT * FROM s UNION ALL SELECT b, a, score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM u)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, score FROM k WHERE r <= 2""")
def _(t, spark, d):
    return neighbours.best_partners(neighbours.co_occurrence(t("lineitem"), "l_suppkey", "l_orderkey"), F.col("shared"), 2)


@query("stereo_pairs", f"""WITH {_PAIRS}, i AS (SELECT s_suppkey AS id, s_acctbal AS x, (s_suppkey * 37 % 1000)::DOUBLE AS y FROM supplier),
q AS (SELECT a, b, shared, {hyp("p.x - r.x", "p.y - r.y")} / 10000 AS ratio FROM c JOIN i p ON p.id = a JOIN i r ON r.id = b), s AS (SELECT a, b, shared * exp(-pow((ratio - 0.35) / 0.2, 2)) AS score FROM q WHERE ratio BETWEEN 0.2 AND 0.67),
u AS (SELECT * FROM s UNION ALL SELECT b, a, score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM u) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(score, 6) AS score FROM k WHERE r <= 2""")
def _(t, spark, d):
    images = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 37 % 1000).cast("double").alias("y"))
    return rounded(neighbours.stereo_pairs(images, neighbours.co_occurrence(t("lineitem"), "l_suppkey", "l_orderkey"), 10_000.0, 2, 1))


@query("connected_components", """WITH s AS (SELECT o_custkey * 2 AS u, o_orderkey * 2 + 1 AS v FROM orders), r AS (SELECT u, least(u, min(v)) AS root FROM s GROUP BY u)
SELECT u AS node, root FROM r UNION SELECT s.v, r.root FROM s JOIN r ON r.u = s.u""")
def _(t, spark, d):
    return graph.components(t("orders").select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") * 2 + 1).alias("v")))


_PATCHES = f"""{SURFACE}, f AS (SELECT "row", col, ("row"::BIGINT << 32) | col AS id, value FROM s WHERE value > 5), ed AS (
SELECT f.id AS u, g.id AS v FROM f JOIN f g ON abs(f."row" - g."row") + abs(f.col - g.col) = 1),
w(node, root) AS (SELECT id, id FROM f UNION SELECT ed.v, w.root FROM w JOIN ed ON ed.u = w.node),
pt AS (SELECT node, min(root) AS patch FROM w GROUP BY node), sz AS (SELECT patch, count(*) AS cells FROM pt GROUP BY patch)"""


@query("raster_patches", f'WITH RECURSIVE {_PATCHES} SELECT f."row", f.col, pt.patch, sz.cells FROM f JOIN pt ON pt.node = f.id JOIN sz USING (patch)')
def _(t, spark, d):
    return graph.raster_patches(surface(spark, d).filter("value > 5"))


# ---- residuals and accuracy --------------------------------------------------------------------

_MAG = f"{RESIDUALS}, g AS (SELECT *, sqrt(dx * dx + dy * dy) AS magnitude FROM r)"


@query("residual_summary", f"WITH {_MAG} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(sqrt(avg(magnitude * magnitude)), 6) AS rms, round(avg(magnitude), 6) AS mean, round(max(magnitude), 6) AS greatest FROM g GROUP BY GROUPING SETS ((kind), ())")
def _(t, spark, d):
    return rounded(residuals.residual_summary(residual_rows(spark, d).withColumn("magnitude", F.hypot("dx", "dy"))))


@query("summary_by_image", f"WITH {RESIDUALS} SELECT image_id, kind, active, count(DISTINCT point_id) AS points, round(sqrt(avg(dx * dx)), 6) AS rms_x, round(sqrt(avg(dy * dy)), 6) AS rms_y FROM r GROUP BY GROUPING SETS ((image_id, kind, active), (kind, active))")
def _(t, spark, d):
    return rounded(residuals.summary_by_image(residual_rows(spark, d)))


@query("residual_table_worst", f"WITH {_MAG} SELECT kind, s_name AS image, point_id, round(magnitude, 6) AS magnitude FROM g LEFT JOIN supplier ON s_suppkey = image_id WHERE kind = 'check'")
def _(t, spark, d):
    r = residual_rows(spark, d)
    images = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"))
    named = r.join(images, "image_id", "left").withColumn("magnitude", near(F.hypot("dx", "dy"), 6)).filter("kind = 'check'")
    return named.select("kind", F.col("name").alias("image"), "point_id", "magnitude")


@query("worst_share", f"WITH {_MAG}, k AS (SELECT magnitude, row_number() OVER (ORDER BY -magnitude, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER () AS n FROM g) SELECT count(*) AS n, round(sqrt(avg(magnitude * magnitude)), 6) AS rms FROM k WHERE r <= greatest(1, floor(n * 0.05))")
def _(t, spark, d):
    return rounded(residuals.worst_share(residual_rows(spark, d).withColumn("magnitude", F.hypot("dx", "dy")), "magnitude", KEYS))


@query("accuracy_statement", f"""WITH {RESIDUALS}, a AS (SELECT count(*) AS n, sqrt(avg(dx * dx)) AS rmse_x, sqrt(avg(dy * dy)) AS rmse_y, sqrt(avg(dz * dz)) AS rmse_z, max(sqrt(dx * dx + dy * dy + dz * dz)) AS greatest FROM r WHERE kind = 'check')
SELECT n, round(rmse_x, 6) AS rmse_x, round(rmse_y, 6) AS rmse_y, round(rmse_z, 6) AS rmse_z, CASE WHEN least(rmse_x, rmse_y) / greatest(rmse_x, rmse_y) >= 0.6 THEN round(2.4477 * (rmse_x + rmse_y) / 2, 6) END AS horizontal_95, round(1.96 * rmse_z, 6) AS vertical_95, round(a.greatest, 6) AS greatest, n >= 30 AS enough FROM a""")
def _(t, spark, d):
    return rounded(residuals.accuracy_statement(residual_rows(spark, d).filter("kind = 'check'")))


@query("mad_screen", f"""WITH {RESIDUALS}, p AS (SELECT kind, point_id, max(abs(dz)) + count(*) AS v FROM r GROUP BY ALL), m AS (SELECT kind, median(v) AS m FROM p GROUP BY kind HAVING count(*) >= 4),
s AS (SELECT p.kind, median(abs(v - m)) AS mad FROM p JOIN m USING (kind) GROUP BY p.kind) SELECT p.kind, point_id, v, round((v - m) / (1.4826 * mad), 6) AS score FROM p JOIN m USING (kind) JOIN s USING (kind) WHERE mad > 0 AND (v - m) / (1.4826 * mad) >= 1.5""")
def _(t, spark, d):
    p = residual_rows(spark, d).groupBy("kind", "point_id").agg((F.max(F.abs("dz")) + F.count(F.lit(1))).alias("v"))
    return rounded(residuals.mad_screen(p, "point_id", "kind", "v", 1.5))


@query("bias_test", f"""WITH {RESIDUALS}, s AS (SELECT image_id, count(dx) AS n, avg(dx) AS mean, stddev_samp(dx) AS sd FROM r GROUP BY image_id HAVING count(dx) >= 40) SELECT image_id, n, round(mean, 6) AS mean, round(abs(mean) / (sd / sqrt(n)), 6) AS t, abs(mean) / (sd / sqrt(n)) > 1.96 AS biased FROM s""")
def _(t, spark, d):
    return rounded(residuals.bias_test(residual_rows(spark, d), "image_id", "dx").filter("n >= 40"))


@query("data_snooping", f"WITH {RESIDUALS} SELECT point_id, max(abs(dz / 7)) AS w, min(1 - abs(dx) / 20) AS redundancy, max(abs(dz / 7)) >= 3.29 AS suspect FROM r GROUP BY point_id")
def _(t, spark, d):
    return residuals.data_snooping(residual_rows(spark, d).withColumns({"w": F.col("dz") / 7, "redundancy": 1 - F.abs("dx") / 20}))


@query("starved_photos", "SELECT o_custkey AS image_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 8")
def _(t, spark, d):
    return residuals.starved_photos(t("orders").select(F.col("o_custkey").alias("image_id")), 8)


@query("single_rays", "WITH s AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) < 2 EXCEPT SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT l_orderkey AS point_id, l_suppkey AS image_id FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM s)")
def _(t, spark, d):
    obs = t("lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))
    return residuals.without_single_rays(obs, t("orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("point_id")))


@query("confusion", """WITH b AS (SELECT l_returnflag AS t, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS g FROM lineitem), c AS (SELECT DISTINCT t AS class FROM b UNION SELECT DISTINCT g FROM b)
SELECT class, round((SELECT count(*) FROM b WHERE t = class AND g = class) / greatest((SELECT count(*) FROM b WHERE g = class), 1), 6) AS precision, round((SELECT count(*) FROM b WHERE t = class AND g = class) / greatest((SELECT count(*) FROM b WHERE t = class), 1), 6) AS recall, (SELECT count(*) FROM b WHERE t = class) AS n FROM c""")
def _(t, spark, d):
    b = t("lineitem").select(F.col("l_returnflag").alias("t"), F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("g"))
    return rounded(residuals.confusion(b, "t", "g"))


@query("confidence_histogram", "SELECT least(floor(l_quantity / 50 * 10), 9)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t, spark, d):
    return residuals.histogram_unit(t("lineitem").select((F.col("l_quantity") / 50).alias("v")), "v")


@query("tie_outliers", "WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem), s AS (SELECT greatest(1.4826 * median(abs(l_extendedprice - m)), 0.5) AS s FROM lineitem, m) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * l_quantity AS z FROM lineitem, m2, s2 WHERE abs(l_extendedprice * l_quantity - m2.m) < 6 * s2.s + 5".replace("WITH m AS", "WITH m2 AS (SELECT median(l_extendedprice * l_quantity) AS m FROM lineitem), s2 AS (SELECT greatest(1.4826 * median(abs(l_extendedprice * l_quantity - m)), 0.5) AS s FROM lineitem, m2), m AS"))
def _(t, spark, d):
    return residuals.tie_outliers(t("lineitem").select(*KEYS, (F.col("l_extendedprice") * F.col("l_quantity")).alias("z")))


@query("cell_top_share", f'WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY z DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, x) AS r FROM c) SELECT "row", col, l_orderkey, l_linenumber, z FROM k WHERE r <= 3')
def _(t, spark, d):
    cells = grid.with_cells(points(spark, d), GRID).withColumn("cell", F.col("row") * GRID.cols + F.col("col"))
    return residuals.rank_in(cells, "cell", [F.desc("z"), *KEYS, "x"], 3).select("row", "col", "l_orderkey", "l_linenumber", "z")


@query("global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def _(t, spark, d):
    return global_rank(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


# ---- imports, joins, sets ----------------------------------------------------------------------

@query("upsert", """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS bal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.id = n.id""")
def _(t, spark, d):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("id % 2 = 0 or id % 3 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("bal") > 0, F.col("bal") * 2).alias("bal"))
    return imports.upsert(c.filter("id % 3 <> 0"), new, "id")


@query("match_names", """WITH i AS (SELECT s_suppkey AS image_id, lower(s_name) || '.tif' AS name FROM supplier), e AS (SELECT c_custkey, replace(lower(c_name), 'customer', 'supplier') || CASE WHEN c_custkey % 2 = 0 THEN '.tif' ELSE '.jpg' END AS name FROM customer)
SELECT e.c_custkey, coalesce((SELECT min(image_id) FROM i WHERE i.name = e.name), (SELECT min(image_id) FROM i WHERE regexp_replace(i.name, '\\.[^.]*$', '') = regexp_replace(e.name, '\\.[^.]*$', ''))) AS image_id FROM e""")
def _(t, spark, d):
    images = t("supplier").select(F.col("s_suppkey").alias("image_id"), F.concat(F.lower("s_name"), F.lit(".tif")).alias("name"))
    name = F.concat(F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")), F.when(F.col("c_custkey") % 2 == 0, ".tif").otherwise(".jpg"))
    return imports.match_names(t("customer").select("c_custkey", name.alias("name")), images).select("c_custkey", "image_id")


@query("unmatched", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t, spark, d):
    return imports.unmatched(t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id")), "id")


@query("number_ids", "SELECT o_orderkey, printf('T%04d', row_number() OVER (ORDER BY o_orderdate, o_orderkey) + (SELECT max(c_custkey) FROM customer)) AS point_id FROM orders")
def _(t, spark, d):
    taken = t("customer").select(F.format_string("T%04d", "c_custkey").alias("point_id"))
    return imports.number_ids(t("orders").select("o_orderkey", "o_orderdate"), taken, "T", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "point_id")


@query("carry_labels", "SELECT o_orderkey AS index, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 2 END, 1)::SMALLINT AS classification FROM orders")
def _(t, spark, d):
    p = t("orders").select(F.col("o_orderkey").alias("index"), F.lit(1).cast("short").alias("classification"))
    return imports.carry_labels(p, p.filter("index % 5 = 0").select("index", F.lit(2).alias("class")))


@query("stale_products", "SELECT o_orderkey AS product_id, o_custkey AS model_id, o_orderstatus AS solution FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IS DISTINCT FROM CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END")
def _(t, spark, d):
    products = t("orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("model_id"), F.col("o_orderstatus").alias("solution"))
    return imports.stale(products, t("customer").select(F.col("c_custkey").alias("model_id"), F.when(F.col("c_acctbal") > 0, "O").otherwise("F").alias("solution")))


@query("deep_merge", "SELECT user_id, arg_max(value, row(ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, row(ts, event_id)) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def _(t, spark, d):
    e = t("events").select("user_id", F.struct("ts", "event_id").alias("o"), *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "view")])
    return imports.deep_merge(e, "user_id", "o", ["click", "view"])


@query("sanity_rules", "SELECT s_suppkey, 'negative' AS code, 'error' AS severity, 'balance below zero' AS message FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'large', 'warning', 'balance over 9000' FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_suppkey, 'nation', 'warning', 'nation is 3' FROM supplier WHERE s_nationkey = 3")
def _(t, spark, d):
    rules = [("negative", "error", F.col("s_acctbal") < 0, "balance below zero"), ("large", "warning", F.col("s_acctbal") > 9000, "balance over 9000"), ("nation", "warning", F.col("s_nationkey") == 3, "nation is 3")]
    return imports.sanity(t("supplier"), rules).select("s_suppkey", "code", "severity", "message")


@query("solution_verdict", "SELECT c_custkey, CASE WHEN c_acctbal < -900 OR abs(c_acctbal) / 300 > 25 THEN 'failed' WHEN abs(c_acctbal) / 300 > 3 THEN 'poor' ELSE 'good' END AS verdict FROM customer")
def _(t, spark, d):
    return t("customer").select("c_custkey", imports.solution_verdict(F.abs("c_acctbal") / 300, F.col("c_acctbal") < -900).alias("verdict"))


@query("first_of_each", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t, spark, d):
    return imports.first_of_each(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("camera_groups", "SELECT p_partkey, dense_rank() OVER (ORDER BY m) - 1 AS grp FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS m FROM part)")
def _(t, spark, d):
    p = t("part")
    groups = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("m"))
    ranked = global_rank(groups, ["m"], "grp")
    return p.join(ranked, (p["p_brand"] == ranked["p_brand"]) & (p["p_size"] == ranked["p_size"])).select("p_partkey", "grp")


# ---- text, JSON, scalars -----------------------------------------------------------------------

@query("european_float", r"""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_acctbal::VARCHAR, '.', ',') WHEN 1 THEN ' ' || c_acctbal::VARCHAR || ' ' WHEN 2 THEN 'n/a' ELSE c_name END AS s FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_acctbal END AS value FROM customer""")
def _(t, spark, d):
    k, s = F.col("c_custkey") % 4, F.col("c_acctbal").cast("string")
    text = F.when(k == 0, F.replace(s, F.lit("."), F.lit(","))).when(k == 1, F.concat(F.lit(" "), s, F.lit(" "))).when(k == 2, "n/a").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", T.european_float(text).alias("value"))


@query("header_key", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '', 'g') AS key FROM part")
def _(t, spark, d):
    return t("part").select("p_partkey", T.header_key(F.col("p_name")).alias("key"))


@query("certificate_number", "SELECT c_custkey, round(-abs(c_acctbal), 2) AS value FROM customer")
def _(t, spark, d):
    token = F.concat(F.lit("f = −"), F.replace(F.format_string("%.2f", F.abs("c_acctbal")), F.lit("."), F.lit(",")), F.lit(" mm ± 0,01"))
    return t("customer").select("c_custkey", T.certificate_number(token).alias("value"))


@query("document_numbers", r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda x: length(x) <= 15)) AS numbers, length(text) AS chars FROM documents")
def _(t, spark, d):
    found = F.filter(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.length(x) <= 15)
    return t("documents").select("doc_id", F.size(found).cast("long").alias("numbers"), F.length("text").cast("long").alias("chars"))


@query("json_projection", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(t, spark, d):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("fingerprint", """SELECT event_id, substr(sha1('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS fingerprint FROM events""")
def _(t, spark, d):
    return t("events").select("event_id", T.fingerprint(F.col("event_type"), F.col("user_id")).alias("fingerprint"))


@query("dms_degrees", "SELECT c_custkey, round((CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END) * (c_nationkey + (c_custkey % 60) / 60.0 + (c_custkey % 7) / 3600.0), 8) AS degrees FROM customer")
def _(t, spark, d):
    dms = F.array(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 60).cast("double"), (F.col("c_custkey") % 7).cast("double"))
    return t("customer").select("c_custkey", near(T.degrees_of(dms, F.when(F.col("c_nationkey") % 2 == 0, "S").otherwise("N")), 8).alias("degrees"))


_ANGLES = "o AS (SELECT c_custkey, c_acctbal / 100000 AS om, c_nationkey / 100.0 AS ph, (c_custkey % 628) / 100.0 AS ka FROM customer)"


@query("collinearity", f"""WITH {_ANGLES}, m AS (SELECT c_custkey, cos(ph) * cos(ka) AS a, cos(om) * sin(ka) + sin(om) * sin(ph) * cos(ka) AS b, sin(om) * sin(ka) - cos(om) * sin(ph) * cos(ka) AS c,
-cos(ph) * sin(ka) AS d, cos(om) * cos(ka) - sin(om) * sin(ph) * sin(ka) AS e, sin(om) * cos(ka) + cos(om) * sin(ph) * sin(ka) AS f, sin(ph) AS g, -sin(om) * cos(ph) AS h, cos(om) * cos(ph) AS i FROM o)
SELECT c_custkey, round(-153.0 * (a * 100 + b * -50 + c * -1500) / (g * 100 + h * -50 + i * -1500), 6) AS x, round(-153.0 * (d * 100 + e * -50 + f * -1500) / (g * 100 + h * -50 + i * -1500), 6) AS y FROM m""")
def _(t, spark, d):
    angles = [F.col("c_acctbal") / 100_000, F.col("c_nationkey") / 100.0, (F.col("c_custkey") % 628) / 100.0]
    x, y = G.project([F.lit(100.0), F.lit(-50.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1500.0)], angles, F.lit(153.0))
    return rounded(t("customer").select("c_custkey", x.alias("x"), y.alias("y")))


@query("remove_distortion", "SELECT c_custkey, round(x * k, 8) AS x, round(y * k, 8) AS y FROM (SELECT c_custkey, x, y, 1 + 0.0001 + 1e-7 * (x * x + y * y) - 2e-12 * pow(x * x + y * y, 2) AS k FROM (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey * 2.0 AS y FROM customer))")
def _(t, spark, d):
    x, y = G.remove_distortion(F.col("c_acctbal") / 100, F.col("c_nationkey") * 2.0, [0.0001, 1e-7, -2e-12])
    return rounded(t("customer").select("c_custkey", x.alias("x"), y.alias("y")), 8)


@query("distortion_round_trip", "SELECT c_custkey, round(c_acctbal / 100, 4) AS x, round(c_nationkey * 2.0, 4) AS y FROM customer")
def _(t, spark, d):
    k = [0.0001, 1e-7, -2e-12]
    x, y = G.remove_distortion(*G.apply_distortion(F.col("c_acctbal") / 100, F.col("c_nationkey") * 2.0, k, steps=12), k)
    return rounded(t("customer").select("c_custkey", x.alias("x"), y.alias("y")), 4)


@query("map_projection_round_trip", "SELECT c_custkey, round(31 + c_acctbal / 10000, 7) AS lon, round(-25 + (c_custkey % 100) / 10.0, 7) AS lat FROM customer")
def _(t, spark, d):
    lon, lat = F.lit(31.0) + F.col("c_acctbal") / 10_000, F.lit(-25.0) + (F.col("c_custkey") % 100) / 10.0
    x, y = G.transverse_mercator(lon, lat, 31.0)
    back = G.transverse_mercator_inverse(F.col("x"), F.col("y"), 31.0)
    return rounded(t("customer").select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", back[0].alias("lon"), back[1].alias("lat")), 7)


@query("robust_weights", "SELECT c_custkey, round(1 / sqrt(1 + pow(c_acctbal / 1000, 2)), 8) AS soft, round(1 / (1 + pow(c_acctbal / 1000, 2)), 8) AS cauchy, round(2 * (sqrt(1 + pow(c_acctbal / 1000, 2)) - 1) * 1e6, 4) AS cost FROM customer")
def _(t, spark, d):
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", near(G.robust_weight(b, "soft_l1", 1000.0), 8).alias("soft"), near(G.robust_weight(b, "cauchy", 1000.0), 8).alias("cauchy"), near(G.robust_cost(b, "soft_l1", 1000.0), 4).alias("cost"))


@query("parabola_peak", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN abs(a - 2 * b + c) < 1e-12 THEN 0 ELSE greatest(-0.5, least(0.5, (a - c) / (2 * (a - 2 * b + c)))) END, 6) AS peak FROM (SELECT *, l_discount * 8 AS a, l_quantity / 4 AS b, l_tax * 16 AS c FROM lineitem)")
def _(t, spark, d):
    return t("lineitem").select(*KEYS, near(G.parabola_peak(F.col("l_discount") * 8, F.col("l_quantity") / 4, F.col("l_tax") * 16), 6).alias("peak"))


# ---- fits --------------------------------------------------------------------------------------

@query("normal_sums", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 4) AS a, round(sum(l_quantity), 4) AS b, count(*)::DOUBLE AS c, round(sum(l_quantity * l_extendedprice), 2) AS d, round(sum(l_extendedprice), 2) AS e FROM lineitem GROUP BY 1")
def _(t, spark, d):
    s = fits.normal_sums(t("lineitem"), [F.col("l_quantity"), F.lit(1.0)], [F.col("l_extendedprice")], ["l_returnflag"])
    return s.select("l_returnflag", near(F.get("ata", F.lit(0)), 4).alias("a"), near(F.get("ata", F.lit(1)), 4).alias("b"), F.get("ata", F.lit(2)).alias("c"), near(F.get("atb", F.lit(0)), 2).alias("d"), near(F.get("atb", F.lit(1)), 2).alias("e"))


@query("affine_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(t, spark, d):
    x, _, _ = fits.fit(t("lineitem"), [F.col("l_quantity"), F.lit(1.0)], [F.col("l_extendedprice")])
    return spark.range(1).select(near(F.lit(float(x[0, 0])), 4).alias("slope"), near(F.lit(float(x[0, 1])), 3).alias("intercept"))


_RAYS = """ry AS (SELECT l_orderkey AS point_id, l_quantity AS cx, l_discount * 100 AS cy, 100.0::DOUBLE AS cz, ((l_orderkey % 50) - l_quantity)::DOUBLE AS dx, 5 - l_discount * 100 AS dy, -100.0::DOUBLE AS dz FROM lineitem),
n2 AS (SELECT *, dx * dx + dy * dy + dz * dz AS q FROM ry),
pj AS (SELECT *, 1 - dx * dx / q AS p00, -dx * dy / q AS p01, -dx * dz / q AS p02, 1 - dy * dy / q AS p11, -dy * dz / q AS p12, 1 - dz * dz / q AS p22 FROM n2),
su AS (SELECT point_id, count(*) AS rays, sum(p00) AS a, sum(p01) AS b, sum(p02) AS c, sum(p11) AS d, sum(p12) AS e, sum(p22) AS f,
  sum(p00 * cx + p01 * cy + p02 * cz) AS r0, sum(p01 * cx + p11 * cy + p12 * cz) AS r1, sum(p02 * cx + p12 * cy + p22 * cz) AS r2 FROM pj GROUP BY point_id),
dt AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM su),
ok AS (SELECT * REPLACE (CASE WHEN abs(det) > 1e-12 THEN det END AS det) FROM dt)"""


@query("ray_points", f"""WITH {_RAYS} SELECT point_id, rays, round((r0 * (d * f - e * e) - b * (r1 * f - e * r2) + c * (r1 * e - d * r2)) / det, 6) AS x,
round((a * (r1 * f - e * r2) - r0 * (b * f - e * c) + c * (b * r2 - r1 * c)) / det, 6) AS y, round((a * (d * r2 - r1 * e) - b * (b * r2 - r1 * c) + r0 * (b * e - d * c)) / det, 6) AS z FROM ok""")
def _(t, spark, d):
    o = t("lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_quantity").alias("cx"), (F.col("l_discount") * 100).alias("cy"), F.lit(100.0).alias("cz"), ((F.col("l_orderkey") % 50) - F.col("l_quantity")).cast("double").alias("dx"), (5 - F.col("l_discount") * 100).alias("dy"), F.lit(-100.0).alias("dz"))
    return rounded(fits.ray_points(o))


# ---- events ------------------------------------------------------------------------------------

def _window_sql(start: str, length: int) -> str:
    return f"make_timestamp(({start}) * 1000000::BIGINT) AT TIME ZONE 'UTC' AS start, make_timestamp((({start}) + {length}) * 1000000::BIGINT) AT TIME ZONE 'UTC' AS \"end\""


def _naive(df: DataFrame) -> DataFrame:
    """Window bounds as times without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns})


@query("events_tumbling", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS greatest FROM events GROUP BY ALL""")
def _(t, spark, d):
    return _naive(rounded(S.windowed(t("events"), "event_type", "value", "1 hour"), 4))


@query("events_sliding", """WITH s AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, start + INTERVAL 3 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS greatest FROM s GROUP BY start, event_type""")
def _(t, spark, d):
    return _naive(rounded(S.windowed(t("events"), "event_type", "value", "3 hours", "1 hour"), 4))


@query("events_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t, spark, d):
    return _naive(S.sessions(t("events"), "user_id", "2 hours"))


@query("events_last_state", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(t, spark, d):
    return S.last_state(t("events"), "user_id", "event_id", "value")


@query("events_throttled", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t, spark, d):
    return S.throttled(t("events"), "user_id", 3600.0, order=["ts", "event_id"]).select("event_id", "user_id")


@query("journal_replay", """WITH b AS (SELECT max(event_id) AS b FROM events WHERE event_type = 'signup'), u AS (SELECT * FROM events, b WHERE event_id >= coalesce(b, 0)) SELECT 'u' || (user_id % 7) AS field, arg_max(value::VARCHAR, event_id) AS value FROM (SELECT user_id, event_id, round_even(value, 0)::BIGINT AS value FROM u WHERE event_type IN ('signup', 'click')) GROUP BY 1""")
def _(t, spark, d):
    e = t("events")
    payload = F.to_json(F.create_map(F.concat(F.lit("u"), F.col("user_id") % 7), F.rint(F.col("value")).cast("long").cast("string")))
    journal = e.select(F.col("event_id").alias("ns"), F.when(F.col("event_type") == "signup", "set_state").when(F.col("event_type") == "click", "patch").otherwise("note").alias("op"), payload.alias("payload"))
    return S.replay(journal, -1)
