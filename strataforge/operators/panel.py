"""From the long signal table to the leakage-checked panel: pivot, adjacency, history, targets, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import STRATA
from . import ranks

LOG_INPUTS = ("current_log", "previous_log", "change_log", "log1p_expected", "log_width", "log_low", "log_medium", "log_high", "log_hard", "high_share", "hard_share")
FLAGGED = ("previous_log", "change_log", "log_low", "log_medium", "log_high", "log_hard")
#: The predictors a model may use, in this order: identity, location, periods and later values are none.
FEATURES = (*LOG_INPUTS, *(f"missing_{c}" for c in FLAGGED))
OPTIONAL = ("previous_log", "log_low", "log_medium", "log_high", "log_hard")
METHODS = ("neutral", "persistence", "historical_mean", "adjusted_persistence")


def unpivot_strata(wide: DataFrame, measures: tuple[str, ...], strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Columns <stratum>_<measure> as one row per stratum, in the strata's order."""
    name = lambda s: s.replace("-", "_")
    kept = [c for c in wide.columns if not any(c == f"{name(s)}_{m}" for s in strata for m in measures)]
    rows = [F.struct(F.lit(k).alias("stratum_order"), F.lit(s).alias("stratum"), *[F.col(f"{name(s)}_{m}").alias(m) for m in measures]) for k, s in enumerate(strata)]
    return wide.select(*kept, F.explode(F.array(*rows)).alias("s_")).select(*kept, "s_.*")


def pivot_strata(signals: DataFrame) -> DataFrame:
    """One row per entity and period. Partial aggregation keeps the shuffle to one row per entity-period and task."""
    at = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    measures = ("n", "observed", "expected", "ratio", "lower", "upper")
    logs = {"log_low": "low", "log_medium": "medium", "log_high": "high", "log_hard": "hard-to-place"}
    return signals.groupBy("entity_key", "period").agg(
        *[at("overall", m).alias(m) for m in measures], *[C.positive_log(at(s, "ratio")).alias(k) for k, s in logs.items()], at("high", "n").alias("n_high"), at("hard-to-place", "n").alias("n_hard")
    )


def adjacent(value: Column, step: int, period: str = "period", over: Window | None = None) -> Column:
    """The value of the row `step` periods away, null over a gap."""
    over = over or Window.partitionBy("entity_key").orderBy(period)
    shift = F.lag if step < 0 else F.lead
    return F.when(shift(period, abs(step)).over(over) == F.col(period) + step, shift(value, abs(step)).over(over))


def build_panel(signals: DataFrame, releases: DataFrame) -> DataFrame:
    """Inputs of each entity and period, the next period's outcome if it is reported, and eligibility.

    One exchange by entity serves the window; the pivot before it is partially aggregated.
    """
    base = pivot_strata(signals).withColumn("current_log", C.comparable_log(F.col("ratio")))
    order = Window.partitionBy("entity_key").orderBy("period")
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({
        "previous_log": adjacent(F.col("current_log"), -1), "target_ratio": adjacent(F.col("ratio"), 1), "target_log": adjacent(F.col("current_log"), 1),
        "first_observed": F.col("period") == F.min("period").over(Window.partitionBy("entity_key")), "history_mean": F.avg("current_log").over(through), "history_count": F.count("current_log").over(through),
    }).join(F.broadcast(releases), "period")
    truth = releases.select((F.col("period") - 1).alias("period"), F.col("published_value").alias("truth_published_value"), F.col("published_precision").alias("truth_published_precision"))
    rows = rows.join(F.broadcast(truth), "period", "left")
    change = F.col("current_log") - F.col("previous_log")
    optional = {c: F.col(c) for c in FLAGGED} | {"change_log": change}
    return rows.select(
        "entity_key", F.col("period").alias("feature_period"), (F.col("period") + 1).alias("target_period"), "n", "expected", "published_value", "published_precision", "current_log", "previous_log",
        F.make_date(F.col("period") + 1, F.lit(12), F.lit(31)).alias("target_end"), "truth_published_value", "truth_published_precision", C.elapsed_fraction(F.col("published_value"), F.col("published_precision"), F.col("period") + 1).alias("elapsed_fraction"),
        change.alias("change_log"), C.log1p_nonneg(F.col("expected")).alias("log1p_expected"), C.interval_log_width(F.col("lower"), F.col("upper")).alias("log_width"),
        "log_low", "log_medium", "log_high", "log_hard", C.share(F.col("n_high"), F.col("n")).alias("high_share"), C.share(F.col("n_hard"), F.col("n")).alias("hard_share"), "target_ratio", "target_log",
        F.col("target_ratio").isNotNull().alias("analytic_eligible"), (F.col("current_log").isNotNull() & (F.col("history_count") >= 2) & ~F.col("first_observed")).alias("public_forecast_eligible"), "first_observed", "history_mean", "history_count",
        *[v.isNull().alias(f"missing_{c}") for c, v in optional.items()],
    )


def feature_matrix(df: DataFrame, *kept: str, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """`kept` columns and the predictors as numbers, nulls preserved. names must be FEATURES in their order."""
    repeated = sorted({c for c in names if names.count(c) > 1})
    unknown, absent = sorted(set(names) - set(FEATURES)), [c for c in FEATURES if c not in names]
    if repeated or unknown or absent or tuple(names) != FEATURES:
        raise ValueError(f"predictors must be the declared ones in their order; repeated: {repeated}, not approved: {unknown}, missing: {absent}")
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise ValueError(f"the table lacks the predictors {lacking}")
    return df.select(*kept, *[F.col(c).cast("double").alias(c) for c in names])


def with_quartile(df: DataFrame, volume: str, *group: str, key: str = "entity_key") -> DataFrame:
    """`df` with the volume quartile of each row in its group, which may be as large as the table."""
    placed = ranks.ranked(df, list(group), [volume, key], "rank_", "size_")
    return placed.withColumn("quartile", (1 + F.floor(4 * (F.col("rank_") - 1) / F.col("size_"))).cast("int")).drop("rank_", "size_")


def rolling_folds(panel: DataFrame, periods: DataFrame, window: int | None = None) -> DataFrame:
    """(eval_period, role) for each panel row: all earlier targets train (or the last `window` of them), the period itself is evaluated.

    periods: the few evaluation periods; they are broadcast, so all folds run together.
    """
    earlier = F.col("target_period") < F.col("eval_period")
    if window:
        earlier &= F.col("target_period") >= F.col("eval_period") - window
    role = F.when(F.col("target_period") == F.col("eval_period"), "evaluate").when(earlier, "train")
    eligible = panel.where("analytic_eligible")
    return eligible.join(F.broadcast(periods), F.col("target_period") <= F.col("eval_period")).withColumn("role", role).where(F.col("role").isNotNull())


def adjusted_persistence(panel: DataFrame, periods: DataFrame, alpha: float) -> DataFrame:
    """Ridge of the target on the current value, by evaluation period: means and slope = Sxy / (Sxx + alpha var(x)).

    Each row is summed for its own target period; an evaluation period adds up the few sums of the earlier ones.
    """
    x, y = F.col("current_log"), F.col("target_log")
    own = panel.where("analytic_eligible").where(x.isNotNull() & y.isNotNull()).groupBy("target_period").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    earlier = own.join(F.broadcast(periods), F.col("target_period") < F.col("eval_period"))
    n, rows = F.col("n"), F.sum("n")
    mean = lambda c: F.sum(n * F.col(c)) / rows
    both = lambda c, a, b: F.sum(n * (F.col(c) + F.col(a) * F.col(b))) / rows - mean(a) * mean(b)  # noqa: E731  within periods and between them
    sums = earlier.groupBy("eval_period").agg(rows.alias("rows"), mean("x").alias("mx"), mean("y").alias("my"), both("cxy", "x", "y").alias("cxy"), both("vx", "x", "x").alias("vx"))
    return sums.select("eval_period", "mx", "my", F.coalesce(F.try_divide(F.col("cxy") * F.col("rows"), F.col("vx") * F.col("rows") + alpha * F.col("vx")), F.lit(0.0)).alias("slope"))


def predict(panel: DataFrame, periods: DataFrame, alpha: float = 10.0) -> DataFrame:
    """Long table of the four methods that need no matrix: one row per entity, target period and model."""
    fitted = adjusted_persistence(panel, periods, alpha)
    evaluated = panel.where("analytic_eligible").withColumn("eval_period", F.col("target_period")).join(F.broadcast(periods), "eval_period")
    rows = with_quartile(evaluated, "log1p_expected", "target_period").join(F.broadcast(fitted), "eval_period")
    value = {"neutral": F.lit(0.0), "persistence": F.col("current_log"), "historical_mean": F.col("history_mean"), "adjusted_persistence": F.col("my") + F.col("slope") * (F.col("current_log") - F.col("mx"))}
    missing = F.exists(F.array(*OPTIONAL), lambda c: c.isNull())
    long = rows.withColumn("any_missing", missing).withColumn("m_", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("predicted_log")) for k, v in value.items()])))
    return long.select("entity_key", "feature_period", "target_period", "m_.model", "n", "quartile", "target_ratio", "target_log", "m_.predicted_log", F.exp("m_.predicted_log").alias("predicted_ratio"), "current_log", "first_observed", "any_missing", "public_forecast_eligible")


def with_errors(predictions: DataFrame) -> DataFrame:
    return predictions.withColumns(C.error_values(*[F.col(c) for c in ("target_ratio", "predicted_ratio", "target_log", "predicted_log")]))


def join_directory(signals: DataFrame, directory: DataFrame) -> DataFrame:
    """Latest name, nation and region by code; entities that the directory lacks keep their code as a name."""
    code = C.key_code(F.col("entity_key"))
    return signals.withColumn("code", code).join(directory, "code", "left").withColumn("name", C.name_or_code(F.col("name"), F.col("code")))


def match_audit(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Every key of two sets, with 'matched', 'left only' or 'right only'."""
    a, b = left.select(*keys).distinct().withColumn("l_", F.lit(1)), right.select(*keys).distinct().withColumn("r_", F.lit(1))
    status = F.when(F.col("r_").isNull(), "left only").when(F.col("l_").isNull(), "right only").otherwise("matched")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def rounding_diagnostics(signals: DataFrame, *by: str) -> DataFrame:
    """How many published ratios the rounding of ratio and expected count can explain.

    Half a unit of the last printed place, the most places seen in the group, is the reach of each number; the range of
    (observed + 2) / (expected + 2) has to meet the published one.
    """
    shown = signals.where(F.col("ratio").isNotNull() & F.col("expected").isNotNull())
    places = shown.groupBy(*by).agg(F.max(C.decimal_places(F.col("expected"))).alias("e_"), F.max(C.decimal_places(F.col("ratio"))).alias("r_"))
    placed = shown.join(F.broadcast(places), list(by))  # one row a group
    half = lambda c: 0.5 * F.pow(F.lit(10.0), -F.col(c))
    top, e, r = F.col("observed") + 2.0, F.col("expected"), F.col("ratio")
    meets = (top / (e + half("e_") + 2.0) <= r + half("r_")) & (F.greatest(F.lit(0.0), r - half("r_")) <= top / (F.greatest(F.lit(0.0), e - half("e_")) + 2.0))
    return placed.where(F.col("observed").isNotNull()).groupBy(*by).agg(F.count("*").alias("checked"), F.count_if(meets).alias("within"), F.count_if(~meets).alias("discrepancies"), F.max("e_").alias("expected_places"), F.max("r_").alias("ratio_places"))
