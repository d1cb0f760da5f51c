"""Errors of predictions: metrics, balanced means, distributions, pairs of models, bands, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut
from . import ranks

SCALES = ("ratio", "percent", "log")
BASELINE = "persistence"


def metrics(errors: DataFrame, *by: str) -> DataFrame:
    """Rows, mean absolute and signed errors and the slope of outcome on prediction, by group and model."""
    return errors.groupBy(*by, "model").agg(
        F.count("*").alias("rows"), F.avg("absolute_log").alias("mae_log"), F.avg("absolute_ratio").alias("mae_ratio"), F.avg("signed_log").alias("mean_signed_log"), F.regr_slope("target_log", "predicted_log").alias("slope")
    )


def with_skill(table: DataFrame, *by: str, value: str = "mae_log", reference: str = BASELINE) -> DataFrame:
    """1 - error / reference error within the group; null where the reference is 0."""
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    of = F.max(F.when(F.col("model") == reference, F.col(value))).over(over)
    return table.withColumn("skill", 1 - F.try_divide(F.col(value), of))


def balanced_mean(errors: DataFrame, *by: str, value: str = "absolute_log", period: str = "target_period") -> DataFrame:
    """The mean over periods of each period's mean, and the pooled mean."""
    inner = errors.groupBy(*by, "model", period).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("rows"))
    return inner.groupBy(*by, "model").agg(F.avg("mean").alias("balanced"), F.try_divide(F.sum("total"), F.sum("rows")).alias("pooled"), F.sum("rows").alias("rows"), F.count("*").alias("periods"))


PLACES = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p95": 0.95}


def with_distribution(table: DataFrame, rows: DataFrame, value: str, *by: str) -> DataFrame:
    """`table`, a row for each group, with exact deciles and percentiles of the groups in `rows`, which may be as large as the table."""
    places = ranks.percentiles(rows, list(by), value, list(PLACES.values())).select(*by, *[F.col("p")[k].alias(name) for k, name in enumerate(PLACES)])
    return table.join(F.broadcast(places), list(by), "left") if by else table.join(F.broadcast(places))


def long_errors(errors: DataFrame, *kept: str, directions: tuple[str, ...] = ("signed", "absolute")) -> DataFrame:
    """One row per prediction, scale and direction."""
    rows = [F.struct(F.lit(s).alias("scale"), F.lit(d).alias("direction"), F.col(f"{d}_{s}").alias("value")) for s in SCALES for d in directions]
    return errors.select(*kept, F.explode(F.array(*rows)).alias("e_")).select(*kept, "e_.*")


def describe(errors: DataFrame, *by: str) -> DataFrame:
    """Distribution of every scale and direction; a group may be as large as the table."""
    keys = [*by, "model", "scale", "direction"]
    long = long_errors(errors, *by, "model")
    whole = long.groupBy(*keys).agg(F.count("value").alias("rows"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return with_distribution(whole, long, "value", *keys)


def tolerance_hits(errors: DataFrame, tolerances: tuple[float, ...], *by: str, value: str = "absolute_percent") -> DataFrame:
    """How many errors are within each tolerance (its bound included)."""
    hits = F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance"), (F.col(value) <= t).alias("hit")) for t in tolerances]))
    return errors.select(*by, "model", hits.alias("h_")).groupBy(*by, "model", "h_.tolerance").agg(F.count("*").alias("rows"), F.count_if("h_.hit").alias("hits"))


def group_summaries(errors: DataFrame, fields: dict[str, Column], value: str = "absolute_log") -> DataFrame:
    """Means by (field, value, period, model) for several fields at once; null values are the group 'Unknown'."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("group_field"), F.coalesce(v.cast("string"), F.lit("Unknown")).alias("group_value")) for k, v in fields.items()]))
    return errors.select("target_period", "model", value, cells.alias("g_")).groupBy("g_.group_field", "g_.group_value", "target_period", "model").agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))


def paired(errors: DataFrame, challenger: str, comparator: str, value: str = "absolute_log") -> DataFrame:
    """challenger - comparator of each entity and period that has both: one aggregation instead of a self-join."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col(value)))
    both = errors.where(F.col("model").isin(challenger, comparator)).groupBy("entity_key", "target_period").agg(of(challenger).alias("challenger"), of(comparator).alias("comparator"))
    return both.where(F.col("challenger").isNotNull() & F.col("comparator").isNotNull()).withColumn("difference", F.col("challenger") - F.col("comparator"))


def group_balanced(summaries: DataFrame) -> DataFrame:
    """From group_summaries: the mean over periods of each group's means."""
    return summaries.groupBy("group_field", "group_value", "model").agg(F.sum("rows").alias("rows"), F.count("*").alias("periods"), F.avg("mean").alias("balanced"))


def wins(differences: DataFrame, *by: str) -> DataFrame:
    d = F.col("difference")
    counted = differences.groupBy(*by).agg(
        F.count("*").alias("rows"), F.countDistinct("entity_key").alias("entities"), F.count_if(d < 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d > 0).alias("losses"), F.avg((d < 0).cast("int")).alias("win_share"),
        F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"),
    )
    return with_distribution(counted, differences, "difference", *by)


def paired_comparison(errors: DataFrame, challenger: str, comparator: str) -> DataFrame:
    """Differences of absolute errors on every scale: level 'period', 'pooled', and 'balanced' (means over periods)."""
    of = lambda m, s: F.max(F.when(F.col("model") == m, F.col(f"absolute_{s}")))
    both = errors.where(F.col("model").isin(challenger, comparator)).groupBy("entity_key", "target_period").agg(*[(of(challenger, s) - of(comparator, s)).alias(s) for s in SCALES])
    both = cut(both)  # read for counts and percentiles of both levels
    long = both.unpivot(["entity_key", "target_period"], list(SCALES), "scale", "difference").where(F.col("difference").isNotNull())
    by_period = wins(long, "target_period", "scale")
    pooled = wins(long, "scale")
    balanced = by_period.groupBy("scale").agg(F.sum("rows").alias("rows"), F.avg("win_share").alias("win_share"), F.avg("mean").alias("mean"))
    named = lambda df, level: df.withColumn("level", F.lit(level))
    return named(by_period, "period").unionByName(named(pooled, "pooled"), allowMissingColumns=True).unionByName(named(balanced, "balanced"), allowMissingColumns=True)


def count_shift(train: DataFrame, evaluation: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, extremes and rows of both sides, and the shift of the mean in training deviations (null where these are 0)."""
    side = lambda df, n: df.agg(F.count("*").alias(f"{n}_rows"), F.avg(value).alias(f"{n}_mean"), F.stddev_pop(value).alias(f"{n}_deviation"), F.min(value).alias(f"{n}_least"), F.max(value).alias(f"{n}_most"))
    both = side(train, "train").join(F.broadcast(side(evaluation, "evaluate")))
    deviation = F.nullif(F.col("train_deviation"), F.lit(0.0))
    return both.withColumns({"shift": (F.col("evaluate_mean") - F.col("train_mean")) / deviation, "reason": F.when(F.col("train_deviation") == 0, "training counts do not vary")})


def band_radius(errors: DataFrame, *by: str, percent: int = 80, least: int = 30, value: str = "absolute_log") -> DataFrame:
    """The value at rank min(n, ceil((n + 1) percent / 100)), an order statistic; null with fewer than `least` rows."""
    wanted = lambda n: [F.least(n, F.ceil((n + 1) * percent / F.lit(100.0)))]
    found = ranks.order_values(errors, list(by), value, [percent / 100], wanted)
    return found.select(*by, F.col("n").alias("rows"), F.when(F.col("n") >= least, F.col("values")[0]).alias("radius"))


def with_bands(errors: DataFrame, radii: DataFrame) -> DataFrame:
    """Bounds from the radius of the model's period before: all null where there is none."""
    shifted = radii.select("model", (F.col("target_period") + 1).alias("target_period"), "radius")
    joined = errors.join(F.broadcast(shifted), ["model", "target_period"], "left")
    p, r = F.col("predicted_log"), F.col("radius")
    return joined.withColumns({"band_lower": F.exp(p - r), "band_upper": F.exp(p + r), "covered": F.col("target_log").between(p - r, p + r), "band_width": 2 * r})


def band_summary(banded: DataFrame, *by: str) -> DataFrame:
    there = F.col("band_lower").isNotNull()
    return banded.groupBy(*by, "model").agg(
        F.count("*").alias("rows"), F.count_if(there).alias("available"), F.count_if(~there).alias("unavailable"), F.count_if("covered").alias("covered"), F.try_divide(F.count_if("covered").cast("double"), F.count_if(there)).alias("coverage"), F.avg("band_width").alias("mean_width")
    )


def association(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson correlation of complete pairs, or the reason why there is none."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by) if by else df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy()
    found = whole.agg(F.count("*").alias("pairs"), F.covar_pop(x, y).alias("c_"), F.stddev_pop(x).alias("sx_"), F.stddev_pop(y).alias("sy_"), (F.min(x) == F.max(x)).alias("fx_"), (F.min(y) == F.max(y)).alias("fy_"))
    reason = F.when(F.col("pairs") < 3, "fewer than 3 pairs").when(F.col("fx_") | F.col("fy_"), "constant")
    return found.select(*by, "pairs", reason.alias("reason"), F.when(reason.isNull(), F.try_divide(F.col("c_"), F.col("sx_") * F.col("sy_"))).alias("correlation"))
