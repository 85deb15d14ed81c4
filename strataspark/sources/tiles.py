"""Clouds laid out by tile, so that a box reads only the tiles it meets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tiles(points: DataFrame, path: str, tile: float) -> None:
    """Write points in folders ``tile_x, tile_y`` of a side ``tile``, near points near each other.

    Rows are dealt by ranges of tile and place, so a tile that holds a third of all points is written by several tasks.
    Points without a place go with tile null and are in no box.
    """
    placed = points.withColumns({"tile_x": F.floor(F.col("x") / tile).cast("int"), "tile_y": F.floor(F.col("y") / tile).cast("int")})
    dealt = placed.repartitionByRange("tile_x", "tile_y", "x", "y").sortWithinPartitions("tile_x", "tile_y", "x", "y")
    dealt.write.partitionBy("tile_x", "tile_y").option("compression", "zstd").parquet(path)


def read_box(spark: SparkSession, path: str, tile: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Points of ``west, south, east, north`` (all edges in): other tiles are not opened, and row groups are pruned by the places in them."""
    west, south, east, north = box
    cells = F.col("tile_x").between(math.floor(west / tile), math.floor(east / tile)) & F.col("tile_y").between(math.floor(south / tile), math.floor(north / tile))
    return spark.read.parquet(path).filter(cells).filter(F.col("x").between(west, east) & F.col("y").between(south, north))


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """``tile_x, tile_y, n`` of each tile, from the footers alone."""
    return spark.read.parquet(path).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def has_tiles(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a finished layout."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
