"""Residual tables, accuracy statements and blunder screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import middle

# Two-sided 5 % points of Student's t for 1 to 30 degrees of freedom; beyond them 1.96.
T_95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def residual_table(residuals: DataFrame, images: DataFrame, control: DataFrame, show: str = "all") -> DataFrame:
    """Residuals ``image_id, point_id, dx, dy`` with names and kinds (``gcp``, ``check``, else ``tie``), worst first."""
    named = residuals.join(images.select("image_id", F.col("name").alias("image")), "image_id", "left").join(
        control.select("point_id", F.when(F.col("is_check"), "check").otherwise("gcp").alias("kind")), "point_id", "left"
    )
    rows = named.withColumns({"kind": F.coalesce("kind", F.lit("tie")), "magnitude": F.hypot("dx", "dy")})
    if show != "all":
        rows = rows.filter(F.col("kind") == show)
    return rows.orderBy(F.desc("magnitude"), "image_id", "point_id")


def residual_summary(residuals: DataFrame, value: str = "magnitude") -> DataFrame:
    """Count, RMS, mean and greatest of each kind, and of all (kind ``all``), in one pass over grouping sets."""
    v = F.col(value)
    sets = residuals.groupingSets([["kind"], []], "kind").agg(F.grouping("kind").alias("g"), F.count(v).alias("n"), rms(v).alias("rms"), F.avg(v).alias("mean"), F.max(v).alias("greatest"))
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", "rms", "mean", "greatest")


def summary_by_image(residuals: DataFrame) -> DataFrame:
    """Distinct points and RMS by axis of each kind and activity: for every image and for the block (image null)."""
    return residuals.groupingSets([["image_id", "kind", "active"], ["kind", "active"]], "image_id", "kind", "active").agg(
        F.count_distinct("point_id").alias("points"), rms(F.col("dx")).alias("rms_x"), rms(F.col("dy")).alias("rms_y")
    )


def worst_share(residuals: DataFrame, value: str, order: list[str], share: float = 0.05) -> DataFrame:
    """RMS of the worst share (at least one row): ``n, rms``. The place of the cut comes from ranks made in range partitions."""
    from .ranks import global_rank

    ranked = global_rank(residuals.withColumn("__neg", -F.col(value)), ["__neg", *order], "rank")
    total = residuals.count()
    kept = ranked.filter(F.col("rank") < max(1, int(total * share)))
    return kept.agg(F.count(F.lit(1)).alias("n"), rms(F.col(value)).alias("rms"))


def accuracy_statement(checks: DataFrame) -> DataFrame:
    """NSSDA figures from check-point residuals ``dx, dy, dz``; the horizontal one only where both axes are alike (ratio 0.6 or more)."""
    x, y = F.col("rmse_x"), F.col("rmse_y")
    low = checks.agg(F.count(F.lit(1)).alias("n"), rms(F.col("dx")).alias("rmse_x"), rms(F.col("dy")).alias("rmse_y"), rms(F.col("dz")).alias("rmse_z"), F.max(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).alias("greatest"))
    ratio = F.least(x, y) / F.when(F.greatest(x, y) > 0, F.greatest(x, y))
    return low.select("n", "rmse_x", "rmse_y", "rmse_z", F.when(ratio >= 0.6, 2.4477 * (x + y) / 2).alias("horizontal_95"), (1.96 * F.col("rmse_z")).alias("vertical_95"), "greatest", (F.col("n") >= 30).alias("enough"))


def bias_test(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and t of each group of three or more, and whether the mean differs from zero at 5 %."""
    s = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter("n >= 3")
    t = F.abs("mean") / F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))
    limit = F.when(F.col("n") - 1 <= len(T_95), F.element_at(F.array(*[F.lit(v) for v in T_95]), F.least(F.col("n") - 1, F.lit(len(T_95))).cast("int"))).otherwise(1.96)
    return s.select(group, "n", "mean", t.alias("t"), F.coalesce(t > limit, F.col("mean") != 0).alias("biased"))


def mad_screen(groups: DataFrame, key: str, kind: str, value: str, limit: float = 3.5) -> DataFrame:
    """Members whose value lies over the median of their kind by ``limit`` scaled median deviations; kinds of four or more."""
    v = F.col(value)
    near = groups.join(middle(groups, v, [kind]).filter("n >= 4"), kind)
    spread = middle(near, F.abs(v - F.col("m")), [kind], "mad").drop("n")
    score = (v - F.col("m")) / (1.4826 * F.when(F.col("mad") > 0, F.col("mad")))
    return near.join(spread, kind).select(kind, key, value, score.alias("score")).filter(F.col("score") >= limit)


def data_snooping(rows: DataFrame, limit: float = 3.29) -> DataFrame:
    """Greatest normalised residual and least redundancy of each point, suspects marked."""
    s = rows.groupBy("point_id").agg(F.max(F.abs("w")).alias("w"), F.min("redundancy").alias("redundancy"))
    return s.withColumn("suspect", F.col("w") >= limit)


def starved_photos(observations: DataFrame, least: int = 3) -> DataFrame:
    """Photos with too few measurements to be placed."""
    return observations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)


def without_single_rays(observations: DataFrame, control: DataFrame) -> DataFrame:
    """Observations of points that are control or seen on two photos or more."""
    seen = observations.groupBy("point_id").agg(F.count_distinct("image_id").alias("photos"))
    single = seen.filter("photos < 2").join(control.select("point_id"), "point_id", "left_anti")
    return observations.join(single, "point_id", "left_anti")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """``class, precision, recall, n`` of every class that is true or guessed somewhere."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    by_t = pairs.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("true"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    by_g = pairs.groupBy(F.col("g").alias("class")).agg(F.sum("n").alias("guessed"))
    hit = F.coalesce("hit", F.lit(0))
    return by_t.join(by_g, "class", "full").select("class", (hit / F.greatest(F.coalesce("guessed", F.lit(0)), F.lit(1))).alias("precision"), (hit / F.greatest(F.coalesce("true", F.lit(0)), F.lit(1))).alias("recall"), F.coalesce("true", F.lit(0)).alias("n"))


def histogram_unit(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts of equal bins over 0..1; the last bin holds 1."""
    return rows.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tie_outliers(points: DataFrame, value: str = "z") -> DataFrame:
    """Points within six robust deviations (of half a metre at least) and five metres of the median height."""
    m = middle(points, value).drop("n")
    near = points.crossJoin(F.broadcast(m))
    s = middle(near, F.abs(F.col(value) - F.col("m")), name="mad").select(F.greatest(1.4826 * F.col("mad"), F.lit(0.5)).alias("s"))
    return near.crossJoin(F.broadcast(s)).filter(F.abs(F.col(value) - F.col("m")) < 6 * F.col("s") + 5).drop("m", "s")


def rank_in(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")
