"""Bounded samples that do not depend on how a table is dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, key_col: str, most: int) -> DataFrame:
    """The rows whose key has one of the ``most`` least hashes (ties of the last one stay); all rows if there are no more."""
    keys = rows.select(F.xxhash64(F.col(key_col)).alias("h"))
    total = keys.count()
    if total <= most:
        return rows
    # the hash is uniform, so the least ``most`` hashes lie under this mark but for a share with odds of under one in a million
    share = (most + 6 * most**0.5) / total
    mark = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    limit = keys.filter(F.col("h") <= F.lit(mark)).orderBy("h").limit(most).agg(F.max("h")).head()[0]
    return rows.filter(F.xxhash64(F.col(key_col)) <= F.lit(limit))
