"""The supplied tables seen as points, grids, residuals and observations; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import Grid, complete, grid_aggregate
from ..session import read_table

GRID = Grid.over(0.0, 0.0, 105_000.0, 50.0, 1000.0, 5.0)  # over price and quantity
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a cloud: x price, y quantity, z discount in per cent."""
    li = read_table(spark, sf_dir, "lineitem")
    total = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return li.select(
        *KEYS, F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"), "l_tax", "l_linestatus",
        F.when(F.col("l_tax") > 0.075, 7).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 5).otherwise(1).alias("classification"),
        F.col("l_linenumber").alias("return_number"), total.alias("number_of_returns"),
    )


POINTS = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, l_quantity AS y, l_discount * 100 AS z, l_tax, l_linestatus,
  CASE WHEN l_tax > 0.075 THEN 7 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 5 ELSE 1 END AS classification,
  l_linenumber AS return_number, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS number_of_returns FROM lineitem)"""

_R = f"greatest(0, least({GRID.rows - 1}, trunc(({GRID.north} - y) / {GRID.cell_y})::INT))"
_C = f"greatest(0, least({GRID.cols - 1}, trunc((x - {GRID.west}) / {GRID.cell_x})::INT))"
CELLS = f'{POINTS}, c AS (SELECT *, {_R} AS "row", {_C} AS col FROM p)'


def surface(spark: SparkSession, sf_dir: str, status: str | None = None, how: str = "mean") -> DataFrame:
    """Cells of the cloud (of one line status), unrounded."""
    p = points(spark, sf_dir)
    return grid_aggregate(p if status is None else p.filter(F.col("l_linestatus") == status), GRID, how)


def full_surface(spark: SparkSession, sf_dir: str, how: str = "mean") -> DataFrame:
    """The surface on its whole lattice, voids as null."""
    return complete(surface(spark, sf_dir, None, how).select("row", "col", near("value", 6).alias("value")), GRID)


SURFACE = f'{CELLS}, s AS (SELECT "row", col, avg(z) AS value FROM c GROUP BY ALL)'
TWO = f"""{CELLS}, a AS (SELECT "row", col, avg(z) AS value FROM c WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT "row", col, avg(z) AS value FROM c WHERE l_linestatus = 'F' GROUP BY ALL)"""
FULL = f"""{SURFACE}, l AS (SELECT r."row", k.col FROM (SELECT unnest(range({GRID.rows}))::INT AS "row") r, (SELECT unnest(range({GRID.cols}))::INT AS col) k),
f AS (SELECT l."row", l.col, round(s.value + 1e-9, 6) AS value FROM l LEFT JOIN s USING ("row", col))"""


def near(value, digits: int):
    """Rounded, with what lies half-way but for the last bit going up."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-9, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as both engines sum in their own order."""
    return df.select(*[near(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as residuals of orders: image supplier, point order, kind by return flag."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("image_id"), F.col("l_orderkey").alias("point_id"), *KEYS,
        F.when(F.col("l_returnflag") == "R", "gcp").when(F.col("l_returnflag") == "A", "check").otherwise("tie").alias("kind"), (F.col("l_linestatus") == "O").alias("active"),
        ((F.col("l_discount") - 0.05) * 100).alias("dx"), ((F.col("l_tax") - 0.04) * 100).alias("dy"), (F.col("l_quantity") - 25).alias("dz"),
    )


RESIDUALS = """r AS (SELECT l_suppkey AS image_id, l_orderkey AS point_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'R' THEN 'gcp' WHEN 'A' THEN 'check' ELSE 'tie' END AS kind, l_linestatus = 'O' AS active,
  (l_discount - 0.05) * 100 AS dx, (l_tax - 0.04) * 100 AS dy, l_quantity - 25 AS dz FROM lineitem)"""

