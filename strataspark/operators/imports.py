"""Imports of survey data into an existing project: upserts, matching by name, patches, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with what the new ones say, and the new rows; a null in a new row leaves the old value. ``state`` tells which."""
    names = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("__o"), *[F.col(c).alias(f"o_{c}") for c in names])
    n = new.select(F.col(key).alias("__n"), *[F.col(c).alias(f"n_{c}") for c in names if c in new.columns])
    both = o.join(n, o["__o"] == n["__n"], "full")
    value = lambda c: F.coalesce(f"n_{c}", f"o_{c}") if c in new.columns else F.col(f"o_{c}")
    state = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "kept").otherwise("updated")
    return both.select(F.coalesce("__n", "__o").alias(key), *[value(c).alias(c) for c in names], state.alias("state"))


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows of an earlier import of the same source go, the new ones come."""
    return old.filter(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.withColumn("source", F.lit(source)))


def match_names(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Entries ``name`` with the ``image_id`` of the image of that name or, failing that, of that stem; null if there is none.

    Of several images of one stem the least id is taken.
    """
    whole = images.groupBy(F.lower("name").alias("k")).agg(F.min("image_id").alias("by_name"))
    stem = images.groupBy(file_stem(F.col("name")).alias("k")).agg(F.min("image_id").alias("by_stem"))
    e = entries.withColumns({"__n": F.lower("name"), "__s": file_stem(F.col("name"))})
    met = e.join(whole, e["__n"] == whole["k"], "left").drop("k").join(stem, e["__s"] == stem["k"], "left").drop("k")
    return met.withColumn("image_id", F.coalesce("by_name", "by_stem")).drop("__n", "__s", "by_name", "by_stem")


def unmatched(entries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return entries.join(known.select(key), key, "left_anti")


def number_ids(rows: DataFrame, taken: DataFrame, prefix: str, order: list[str], key: str = "point_id") -> DataFrame:
    """Ids ``prefix`` and four digits for rows in order, behind the greatest number already taken."""
    from .ranks import global_rank

    number = F.regexp_extract(F.col(key), rf"^{prefix}(\d+)$", 1).try_cast("long")
    last = taken.agg(F.coalesce(F.max(number), F.lit(0)).alias("last"))
    ranked = global_rank(rows, order, "__rank").crossJoin(F.broadcast(last))
    return ranked.withColumn(key, F.format_string(f"{prefix}%04d", F.col("__rank") + F.col("last") + 1)).drop("__rank", "last")


def carry_labels(points: DataFrame, labels: DataFrame, key: str = "index") -> DataFrame:
    """Classes with hand-given labels over them."""
    named = labels.select(key, F.col("class").alias("__label"))
    return points.join(named, key, "left").withColumn("classification", F.coalesce("__label", "classification").cast("short")).drop("__label")


def stale(products: DataFrame, current: DataFrame) -> DataFrame:
    """Products whose recorded solution is not that of their model now; those without a model are stale too."""
    now = current.select(F.col("model_id").alias("m"), F.col("solution").alias("now"))
    return products.join(now, products["model_id"] == now["m"], "left").filter(~F.col("solution").eqNullSafe(F.col("now"))).drop("m", "now")


def deep_merge(states: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Patches (null: not touched) applied in order: of each field the last value that is set."""
    last = lambda f: F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order)))
    return states.groupBy(key).agg(*[last(f).alias(f) for f in fields])


def first_of_each(df: DataFrame, group: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def sanity(df: DataFrame, rules: list[tuple[str, str, object, str]]) -> DataFrame:
    """One row for each row and rule that holds: the columns of ``df`` and ``code, severity, message``."""
    found = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(text).alias("message"))) for code, level, test, text in rules]
    return df.withColumn("__p", F.explode(F.array_compact(F.array(*found)))).select(*df.columns, "__p.*")


def solution_verdict(rms_px, below_ground):
    """``failed`` if a photo lies below the ground or the residual is over 25 pixels, ``poor`` over 3, else ``good``."""
    return F.when(below_ground | (rms_px > 25), "failed").when(rms_px > 3, "poor").otherwise("good")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
