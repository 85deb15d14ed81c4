"""Exact quantiles of groups of any size, by selection: bounds from a sketch, counts below them, ranks of what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

GATHER = 200_000  # rows of a group up to which one aggregate buffer may hold its values
WIDTH = 0.002  # share of a group's rows on each side of a wanted rank that the bounds leave between them
ACCURACY = 5_000


def exact_quantiles(rows: DataFrame, value: Column | str, shares: list[float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``by.., n, q`` of each group: the count of its values and the quantiles of ``shares``, with linear interpolation; nulls do not count.

    Where no group has more than ``GATHER`` values one aggregate gives them. Else three passes over the narrow values: a
    sketch gives each wanted rank two bounds that it lies between; a histogram over the bounds counts what lies below
    them; and what lies between, some ``2 * WIDTH`` of the rows a share, is summed up by distinct value, dealt in
    ranges of values and ranked, so a task holds one range of distinct values at most and a value that very many rows have is one
    row. A rank outside its bounds (which a sketch's error would have to cause) is looked for among all values. Without groups an
    empty table gives one row with count 0 and null.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    v = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).filter("__v is not null")
    most = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if most <= GATHER:
        return v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("__v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    return _select(materialise(v, "quantile-values"), [float(s) for s in shares], by)


def _select(values: DataFrame, shares: list[float], by: list[str]) -> DataFrame:
    wanted = sorted(set(shares))
    sides = [max(0.0, s - WIDTH) for s in wanted] + [min(1.0, s + WIDTH) for s in wanted]
    k = len(wanted)
    sketch = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", sides, ACCURACY).alias("__s"))
    rank = [F.lit(s) * (F.col("n") - 1) for s in wanted]
    bounds = sketch.select(
        *by, "n", F.slice("__s", 1, k).alias("__lows"), F.slice("__s", k + 1, k).alias("__highs"),
        F.array(*[F.floor(r).cast("long") for r in rank]).alias("__first"), F.array(*[(r - F.floor(r)) for r in rank]).alias("__part"),
    )
    bounds = materialise(bounds, "quantile-bounds")
    near = _with(values, bounds, by)

    # how many values lie below the low bound of each share: the low bounds rise, so a histogram over them tells
    place = F.size(F.filter("__lows", lambda x: x <= F.col("__v")))
    counts = near.groupBy(*by, place.alias("__place")).agg(F.count(F.lit(1)).alias("__c"))
    below = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__place", "__c"))).alias("__hist"))  # a row for each share at most
    under = below.select(*by, F.array(*[_up_to(F.col("__hist"), t) for t in range(k)]).alias("__under"))

    target = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: (F.get("__lows", t) <= F.col("__v")) & (F.col("__v") <= F.get("__highs", t))))
    between = near.select(*by, target.alias("__t"), "__v").groupBy(*by, "__t", "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = materialise(_ranked(between, [*by, "__t"]), "quantile-ranked")

    state = _with(ranked, _with(bounds, under, by), by)
    first = F.get("__first", F.col("__t")) - F.get("__under", F.col("__t"))
    last = F.when(F.get("__part", F.col("__t")) > 0, first + 1).otherwise(first)
    picked = state.groupBy(*by, "__t").agg(
        F.max(F.col("__before") + F.col("__c")).alias("__all"), F.max(first).alias("__a"), F.max(last).alias("__b"), F.max(F.get("__part", F.col("__t"))).alias("__w"),
        F.min(F.when(F.col("__before") + F.col("__c") > first, F.col("__v"))).alias("__x"), F.min(F.when(F.col("__before") + F.col("__c") > last, F.col("__v"))).alias("__y"),
    )
    if not picked.filter("__a < 0 or __b >= __all").isEmpty():  # a bound that does not hold: all distinct values are ranked
        return _ranked_whole(values, wanted, shares, by)
    low, high = F.col("__x"), F.col("__y")
    value = F.when(low == high, low).otherwise(low + (high - low) * F.col("__w"))
    found = picked.select(*by, "__t", value.alias("__q")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__t", "__q"))).alias("__q"))
    return _with(bounds.select(*by, "n"), found, by).select(*by, "n", F.array(*[F.element_at("__q", F.lit(wanted.index(s))) for s in shares]).alias("q"))


def _up_to(hist: Column, place: int) -> Column:
    """Sum of a map's values whose keys are at most ``place``."""
    held = F.map_entries(F.map_filter(hist, lambda p, _: p <= place))
    return F.aggregate(held, F.lit(0).cast("long"), lambda s, e: s + e["value"])


def _ranked(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__before``: how many rows of the same keys have a smaller ``__v``. Ranges of keys and values are ranked in a task each, and their sums carried over."""
    parts = materialise(distinct.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()), "quantile-ranges")
    sums = parts.groupBy(*keys, "__p").agg(F.sum("__c").alias("__s"))
    carried = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "__p", F.coalesce(F.sum("__s").over(carried), F.lit(0)).alias("__carry"))
    own = Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("__in", F.coalesce(F.sum("__c").over(own), F.lit(0)))
    return _with(inside, carry, [*keys, "__p"]).select(*keys, "__v", "__c", (F.col("__in") + F.col("__carry")).alias("__before"))


def _ranked_whole(values: DataFrame, wanted: list[float], shares: list[float], by: list[str]) -> DataFrame:
    distinct = values.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = materialise(_ranked(distinct, by) if by else _ranked(distinct.withColumn("__g", F.lit(0)), ["__g"]), "quantile-whole")
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    end, out = F.col("__before") + F.col("__c"), []
    for s in wanted:
        r = F.lit(s) * (F.col("n") - 1)
        low, high = F.min(F.when(end > F.floor(r), F.col("__v"))), F.min(F.when(end > F.ceil(r), F.col("__v")))
        part = F.max(r - F.floor(r))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * part))
    return _with(ranked, sizes, by).groupBy(*by).agg(F.max("n").alias("n"), F.array(*[out[wanted.index(s)] for s in shares]).alias("q"))


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the columns of the row of ``right`` of its group (a null key is a group of its own)."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(c).alias(f"__r{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = [left[c].eqNullSafe(renamed[f"__r{k}"]) for k, c in enumerate(by)]
    return left.join(renamed, same).drop(*[f"__r{k}" for k in range(len(by))])


def middle(rows: DataFrame, value: Column | str, by: list[str] | tuple[str, ...] = (), name: str = "m") -> DataFrame:
    """``by.., n, name``: the count and the median of each group."""
    return exact_quantiles(rows, value, [0.5], by).select(*by, "n", F.get("q", F.lit(0)).alias(name))
