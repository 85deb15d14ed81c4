"""Ranks over whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank by ``order``: range partitions, a rank in each, and the sizes of those before (one number a partition)."""
    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    base, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        base.append(at)
        at += sizes.get(p, 0)
    offsets = F.get(F.array(*[F.lit(b).cast("long") for b in base or [0]]), F.col("__part"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn(name, own + offsets).drop("__part")
