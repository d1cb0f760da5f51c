"""Queries over predictions: folds, errors, comparisons, bands, bootstraps, ridge models, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks, evaluate, gates, intervals, models, panel, resample
from ..sources import tables as T
from .panel_queries import eval_periods, predictions, r6, the_panel
from .duck import view
from .register import register

FEATURES = list(panel.FEATURES)
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


def six(df, *plain: str):
    """Doubles rounded to six places; the other columns as they are."""
    return df.select(*[r6(c) if t == "double" and c not in plain else F.col(c) for c, t in df.dtypes])


@register("SELECT model, round(avg(mean), 6) AS balanced, round(sum(total) / sum(rows), 6) AS pooled, sum(rows)::BIGINT AS rows, count(*) AS periods FROM (SELECT model, target_period, avg(absolute_log) AS mean, sum(absolute_log) AS total, count(*) AS rows FROM errors GROUP BY ALL) GROUP BY model", "errors")
def balanced_mae(spark, sf):
    return six(evaluate.balanced_mean(predictions(spark, sf)))


@register("SELECT e.target_period AS eval_period, CASE WHEN p.target_period = e.target_period THEN 'evaluate' ELSE 'train' END AS role, p.target_period, count(*) AS rows FROM (SELECT DISTINCT target_period FROM panel WHERE target_period BETWEEN 1998 AND 2000) e JOIN panel p ON p.target_period <= e.target_period AND p.analytic_eligible GROUP BY ALL", "panel")
def rolling_folds(spark, sf):
    return panel.rolling_folds(the_panel(spark, sf), eval_periods(spark, sf)).groupBy("eval_period", "role", "target_period").agg(F.count("*").alias("rows"))


@register("SELECT entity_key, target_period, model, round(predicted_log, 6) AS predicted_log, round(predicted_ratio, 6) AS predicted_ratio, quartile FROM predictions WHERE model <> 'adjusted_persistence'", "predictions")
def baseline_predictions(spark, sf):
    p = predictions(spark, sf).where("model <> 'adjusted_persistence'")
    return p.select("entity_key", "target_period", "model", r6("predicted_log"), r6("predicted_ratio"), "quartile")


@register("SELECT entity_key, target_period, round(predicted_log, 6) AS predicted_log FROM predictions WHERE model = 'adjusted_persistence'", "predictions")
def adjusted_persistence(spark, sf):
    return predictions(spark, sf).where("model = 'adjusted_persistence'").select("entity_key", "target_period", r6("predicted_log"))


@register("SELECT entity_key, target_period, quartile FROM predictions WHERE model = 'neutral'", "predictions")
def volume_quartiles(spark, sf):
    return predictions(spark, sf).where("model = 'neutral'").select("entity_key", "target_period", "quartile")


@register("SELECT entity_key, feature_period, round(history_mean, 6) AS history_mean, history_count FROM panel", "panel")
def historical_mean(spark, sf):
    return the_panel(spark, sf).select("entity_key", "feature_period", r6("history_mean"), "history_count")


_METRICS = "model, count(*) AS rows, round(avg(absolute_log), 6) AS mae_log, round(avg(absolute_ratio), 6) AS mae_ratio, round(avg(signed_log), 6) AS mean_signed_log, round(CASE WHEN min(predicted_log) < max(predicted_log) THEN regr_slope(target_log, predicted_log) END, 6) AS slope FROM errors"


@register(f"SELECT target_period, {_METRICS} GROUP BY ALL", "errors")
def metrics_by_year(spark, sf):
    return six(evaluate.metrics(predictions(spark, sf), "target_period"))


@register(f"SELECT target_period, quartile, {_METRICS} GROUP BY ALL", "errors")
def metrics_by_quartile(spark, sf):
    return six(evaluate.metrics(predictions(spark, sf), "target_period", "quartile"))


@register("SELECT target_period, model, round(mae, 6) AS mae_log, round(1 - mae / nullif(max(mae) FILTER (model = 'persistence') OVER (PARTITION BY target_period), 0), 6) AS skill FROM (SELECT target_period, model, avg(absolute_log) AS mae FROM errors GROUP BY ALL)", "errors")
def skill_scores(spark, sf):
    table = evaluate.with_skill(evaluate.metrics(predictions(spark, sf), "target_period"), "target_period")
    return six(table.select("target_period", "model", "mae_log", "skill"))


_SCALES = [f"{d}_{s}" for s in evaluate.SCALES for d in ("signed", "absolute")]


@register("SELECT entity_key, target_period, model, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCALES) + " FROM errors", "errors")
def error_scales(spark, sf):
    return predictions(spark, sf).select("entity_key", "target_period", "model", *[r6(c) for c in _SCALES])


_LONG = "SELECT *, unnest(['ratio', 'ratio', 'percent', 'percent', 'log', 'log']) AS scale, unnest(['signed', 'absolute', 'signed', 'absolute', 'signed', 'absolute']) AS direction, unnest([" + ", ".join(_SCALES) + "]) AS value FROM errors"
_DIST = "round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.1), 6) AS p10, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.9), 6) AS p90, round(quantile_cont({v}, 0.95), 6) AS p95, round(min({v}), 6) AS least, round(max({v}), 6) AS most"


@register(f"SELECT target_period, model, scale, direction, count(value) AS rows, {_DIST.format(v='value')} FROM ({_LONG}) GROUP BY ALL", "errors")
def error_distribution(spark, sf):
    return six(evaluate.describe(predictions(spark, sf), "target_period"))


@register("SELECT model, tolerance, count(*) AS rows, count(*) FILTER (absolute_percent <= tolerance) AS hits FROM errors, (VALUES (5::DOUBLE), (10::DOUBLE), (25::DOUBLE)) t(tolerance) GROUP BY ALL", "errors")
def tolerance_hits(spark, sf):
    return evaluate.tolerance_hits(predictions(spark, sf), (5.0, 10.0, 25.0))


_BUCKET = "CASE WHEN exp(current_log) < 0.5 THEN '<0.5' WHEN exp(current_log) < 1 THEN '0.5-1' WHEN exp(current_log) < 2 THEN '1-2' ELSE '>=2' END"


def groups():
    return {"quartile": F.col("quartile"), "earlier": C.ratio_bucket(F.exp("current_log")), "missing": F.col("any_missing"), "first": F.col("first_observed"), "public": F.col("public_forecast_eligible")}


@register(f"SELECT DISTINCT entity_key, target_period, {_BUCKET} AS earlier, any_missing FROM predictions", "predictions")
def earlier_groups(spark, sf):
    return predictions(spark, sf).select("entity_key", "target_period", C.ratio_bucket(F.exp("current_log")).alias("earlier"), "any_missing").distinct()


_GROUPED = f"SELECT *, unnest(['quartile', 'earlier', 'missing', 'first', 'public']) AS group_field, unnest([quartile::VARCHAR, {_BUCKET}, any_missing::VARCHAR, first_observed::VARCHAR, public_forecast_eligible::VARCHAR]) AS group_value FROM errors"


@register(f"SELECT group_field, coalesce(group_value, 'Unknown') AS group_value, target_period, model, count(*) AS rows, round(avg(absolute_log), 6) AS mean FROM ({_GROUPED}) GROUP BY ALL", "errors")
def group_summaries(spark, sf):
    return six(evaluate.group_summaries(predictions(spark, sf), groups()))


@register(f"SELECT group_field, group_value, model, sum(rows)::BIGINT AS rows, count(*) AS periods, round(avg(mean), 6) AS balanced FROM (SELECT group_field, coalesce(group_value, 'Unknown') AS group_value, target_period, model, count(*) AS rows, avg(absolute_log) AS mean FROM ({_GROUPED}) GROUP BY ALL) GROUP BY ALL", "errors")
def group_balanced(spark, sf):
    """The mean over periods of each group's means."""
    return six(evaluate.group_balanced(evaluate.group_summaries(predictions(spark, sf), groups())))


_PAIRED = "SELECT entity_key, target_period, max(absolute_log) FILTER (model = 'historical_mean') AS challenger, max(absolute_log) FILTER (model = 'persistence') AS comparator FROM errors GROUP BY ALL"


def differences(spark, sf):
    return evaluate.paired(predictions(spark, sf), "historical_mean", "persistence")


@register(f"SELECT entity_key, target_period, round(challenger, 6) AS challenger, round(comparator, 6) AS comparator, round(challenger - comparator, 6) AS difference FROM ({_PAIRED})", "errors")
def paired_differences(spark, sf):
    return six(differences(spark, sf))


_OF = "max(absolute_{s}) FILTER (model = 'historical_mean') - max(absolute_{s}) FILTER (model = 'persistence')"
_BY_SCALE = "SELECT entity_key, target_period, unnest(['ratio', 'percent', 'log']) AS scale, unnest([ratio, percent, log]) AS d FROM (SELECT entity_key, target_period, " + ", ".join(f"{_OF.format(s=x)} AS {x}" for x in evaluate.SCALES) + " FROM errors GROUP BY ALL)"
_WINS = f"scale, count(*) AS rows, count(DISTINCT entity_key) AS entities, count(*) FILTER (d < 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d > 0) AS losses, avg((d < 0)::INTEGER) AS win_share, {_DIST.format(v='d').replace('round(avg(d), 6)', 'avg(d)')}"


@register(
    f"""SELECT level, target_period, scale, rows, entities, wins, ties, losses, round(win_share, 6) AS win_share, round(mean, 6) AS mean, p10, median, p90, p95, least, most FROM (SELECT 'period' AS level, target_period, {_WINS} FROM ({_BY_SCALE}) GROUP BY ALL UNION ALL SELECT 'pooled', NULL, {_WINS} FROM ({_BY_SCALE}) GROUP BY ALL
    UNION ALL SELECT 'balanced', NULL, scale, sum(rows)::BIGINT, NULL, NULL, NULL, NULL, avg(win_share), avg(mean), NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT target_period, {_WINS} FROM ({_BY_SCALE}) GROUP BY ALL) GROUP BY scale)""",
    "errors",
)
def paired_wins(spark, sf):
    """Wins, ties, losses and differences on each scale: by period, pooled, and balanced over periods."""
    return six(evaluate.paired_comparison(predictions(spark, sf), "historical_mean", "persistence"))


_RADIUS = "SELECT target_period, model, rows, CASE WHEN rows >= 30 THEN absolute_log END AS radius FROM (SELECT *, row_number() OVER (PARTITION BY target_period, model ORDER BY absolute_log) AS place, count(*) OVER (PARTITION BY target_period, model) AS rows FROM errors) WHERE place = least(rows, ((rows + 1) * 80 + 99) // 100)"


@register(f"SELECT target_period, model, rows, round(radius, 6) AS radius FROM ({_RADIUS})", "errors")
def band_radius(spark, sf):
    return six(evaluate.band_radius(predictions(spark, sf), "target_period", "model"))


def banded(spark, sf):
    p = predictions(spark, sf)
    return evaluate.with_bands(p, evaluate.band_radius(p, "target_period", "model"))


_BANDED = f"SELECT e.*, r.radius, exp(predicted_log - r.radius) AS band_lower, exp(predicted_log + r.radius) AS band_upper, target_log BETWEEN predicted_log - r.radius AND predicted_log + r.radius AS covered FROM errors e LEFT JOIN ({_RADIUS}) r ON r.model = e.model AND r.target_period = e.target_period - 1"


@register(f"SELECT entity_key, target_period, model, round(ln(band_lower), 6) AS log_lower, round(ln(band_upper), 6) AS log_upper, covered FROM ({_BANDED})", "errors")
def prediction_bands(spark, sf):
    return banded(spark, sf).select("entity_key", "target_period", "model", r6(F.log("band_lower"), "log_lower"), r6(F.log("band_upper"), "log_upper"), "covered")


@register(f"SELECT target_period, model, count(*) AS rows, count(band_lower) AS available, count(*) - count(band_lower) AS unavailable, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered)::DOUBLE / nullif(count(band_lower), 0), 6) AS coverage, round(avg(2 * radius), 6) AS mean_width FROM ({_BANDED}) GROUP BY ALL", "errors")
def band_coverage(spark, sf):
    return six(evaluate.band_summary(banded(spark, sf), "target_period"))


@register(f"SELECT target_period, quartile, model, count(*) AS rows, count(band_lower) AS available, count(*) - count(band_lower) AS unavailable, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered)::DOUBLE / nullif(count(band_lower), 0), 6) AS coverage, round(avg(2 * radius), 6) AS mean_width FROM ({_BANDED}) GROUP BY ALL", "errors")
def comparison_bands(spark, sf):
    return six(evaluate.band_summary(banded(spark, sf), "target_period", "quartile"))


@register("SELECT CASE WHEN target_period > 2000 THEN 'incomplete period' WHEN target_log IS NULL THEN 'missing target' WHEN NOT public_forecast_eligible THEN 'ineligible' ELSE 'eligible' END AS reason, count(DISTINCT (entity_key, feature_period)) AS rows FROM panel GROUP BY ALL", "panel")
def exclusion_counts(spark, sf):
    reason = F.when(F.col("target_period") > 2000, "incomplete period").when(F.col("target_log").isNull(), "missing target").when(~F.col("public_forecast_eligible"), "ineligible").otherwise("eligible")
    return the_panel(spark, sf).groupBy(reason.alias("reason")).agg(F.countDistinct("entity_key", "feature_period").alias("rows"))


@register("SELECT target_period, " + ", ".join(f"round(avg(absolute_log) FILTER (model = '{m}'), 6) AS {m}" for m in panel.METHODS) + " FROM errors GROUP BY ALL", "errors")
def model_comparison_wide(spark, sf):
    table = evaluate.metrics(predictions(spark, sf), "target_period")
    return six(table.groupBy("target_period").pivot("model", list(panel.METHODS)).agg(F.first("mae_log")))


@register("SELECT entity_key, target_period, model, role, round(predicted_log, 6) AS predicted_log FROM (SELECT *, 'baseline' AS role FROM predictions WHERE model <> 'adjusted_persistence' UNION ALL SELECT *, 'fitted' FROM predictions WHERE model = 'adjusted_persistence')", "predictions")
def collect_predictions(spark, sf):
    """A wide and a long table of predictions as one long table with the role of each model."""
    p = predictions(spark, sf)
    wide = p.where("model <> 'adjusted_persistence'").groupBy("entity_key", "target_period").pivot("model", ["neutral", "persistence", "historical_mean"]).agg(F.first("predicted_log"))
    long = wide.unpivot(["entity_key", "target_period"], ["neutral", "persistence", "historical_mean"], "model", "predicted_log").withColumn("role", F.lit("baseline"))
    fitted = p.where("model = 'adjusted_persistence'").select("entity_key", "target_period", "model", "predicted_log", F.lit("fitted").alias("role"))
    return six(long.unionByName(fitted))


@register(
    """SELECT entity_key, target_period, rule FROM (SELECT *, unnest(['models missing', 'targets differ', 'flags differ', 'groups differ']) AS rule, unnest([k % 13 = 6, k % 14 = 3, k % 15 = 4, k % 16 = 5 AND k % 13 <> 6]) AS bad FROM (SELECT *, CAST(substr(entity_key, 2, 6) AS INTEGER) AS k FROM predictions WHERE model = 'persistence')) WHERE bad""",
    "predictions",
)
def violations_pairing(spark, sf):
    """Every entity and period has every model, with one target, one set of flags and one group; some rows are made wrong here."""
    k, model = F.substring("entity_key", 2, 6).cast("int"), F.col("model")
    put = lambda bad, value, c: F.when(bad, value).otherwise(F.col(c))
    p = predictions(spark, sf).where(~((model == "neutral") & (k % 13 == 6))).withColumns({
        "target_ratio": put((model == "persistence") & (k % 14 == 3), F.col("target_ratio") + 1, "target_ratio"), "first_observed": put((model == "historical_mean") & (k % 15 == 4), ~F.col("first_observed"), "first_observed"),
        "quartile": put((model == "neutral") & (k % 16 == 5), F.col("quartile") + 1, "quartile"),
    })
    return checks.pairing(p, panel.METHODS, "target_ratio", ("first_observed", "any_missing", "public_forecast_eligible"), ("quartile",))


@register("SELECT entity_key, target_period, model, CASE WHEN extra THEN 'right only' ELSE 'left only' END AS status FROM (SELECT entity_key, target_period, model, false AS extra FROM predictions WHERE model = 'neutral' AND CAST(substr(entity_key, 2, 6) AS INTEGER) % 13 = 6 UNION ALL SELECT entity_key, target_period - 10, model, true FROM predictions WHERE CAST(substr(entity_key, 2, 6) AS INTEGER) % 17 = 2)", "predictions")
def violations_coverage(spark, sf):
    """Predictions that the panel's keys and the models ask for and that are missing ('left only'), and those that nobody asked for."""
    k = F.substring("entity_key", 2, 6).cast("int")
    wanted = the_panel(spark, sf).where("analytic_eligible AND target_period BETWEEN 1998 AND 2000").select("entity_key", "target_period", F.explode(F.array(*[F.lit(m) for m in panel.METHODS])).alias("model"))
    p = predictions(spark, sf).select("entity_key", "target_period", "model")
    found = p.where(~((F.col("model") == "neutral") & (k % 13 == 6))).unionByName(p.where(k % 17 == 2).withColumn("target_period", F.col("target_period") - 10))
    return panel.match_audit(wanted, found, "entity_key", "target_period", "model").where("status <> 'matched'")


@register("SELECT entity_key, target_period, CASE WHEN CAST(substr(entity_key, 2, 6) AS INTEGER) % 9 = 1 THEN 'computed only' ELSE 'both' END AS status, CASE WHEN CAST(substr(entity_key, 2, 6) AS INTEGER) % 9 = 1 THEN NULL WHEN CAST(substr(entity_key, 2, 6) AS INTEGER) % 9 = 2 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS difference FROM predictions WHERE model = 'persistence'", "predictions")
def reconstruction_diff(spark, sf):
    computed = predictions(spark, sf).where("model = 'persistence'").select("entity_key", "target_period", "predicted_log")
    k = F.substring("entity_key", 2, 6).cast("int") % 9
    stored = computed.where(k != 1).withColumn("predicted_log", F.col("predicted_log") + F.when(k == 2, 0.5).otherwise(0.0))
    return six(checks.differences(stored, computed, ["entity_key", "target_period"], "predicted_log"))


@register(
    """SELECT 'several roles' AS rule, target_period::VARCHAR AS item, 'development, replay' AS detail FROM predictions WHERE target_period = 1999 AND CAST(substr(entity_key, 2, 6) AS INTEGER) % 12 = 1 GROUP BY ALL
    UNION ALL SELECT 'several dates', release::VARCHAR, release || '-07-07, ' || release || '-08-01' FROM annual WHERE release % 4 = 2 AND CAST(substr(entity_key, 2, 6) AS INTEGER) % 9 = 2 GROUP BY ALL
    UNION ALL SELECT 'order of dates', '2000', '1998-07-07' FROM (SELECT DISTINCT release FROM annual WHERE release = 2000)""",
    "predictions", "annual",
)
def violations_roles(spark, sf):
    """Periods with several evidence roles, releases with several dates of publication, releases whose dates don't follow their order."""
    k, period, release = F.substring("entity_key", 2, 6).cast("int"), F.col("target_period"), F.col("release")
    role = F.when((period == T.LAST_PERIOD) | ((period == 1999) & (k % 12 == 1)), "replay").otherwise("development")
    dated = F.concat(F.when(release == 2000, 1998).otherwise(release).cast("string"), F.when((release % 4 == 2) & (k % 9 == 2), "-08-01").otherwise("-07-07"))
    annual = T.annual(spark, sf).select(release, dated.alias("published"))
    return checks.roles(predictions(spark, sf).select(period.alias("item"), role.alias("value"))).unionByName(checks.release_dates(annual))


# bootstraps
def draw_sql(seed: int = 7) -> str:
    """The rank drawn by (replicate, rank as slot) among n, as `resample.draw` draws it in one range."""
    word = "18446744073709551616::UHUGEINT"
    z = f"(({seed * resample.FACTORS[0] % 2**64}::UHUGEINT + replicate::UHUGEINT * {resample.FACTORS[1]}::UHUGEINT + rank::UHUGEINT * {resample.FACTORS[3]}::UHUGEINT) % {word})"
    for shift, factor in resample.MIXERS:
        z = f"(xor({z}, {z} >> {shift}) * {factor}::UHUGEINT % {word})"
    return f"(xor({z}, {z} >> 31) % n::UHUGEINT)::BIGINT"


_DRAWS = f"""WITH_PREFIX d AS (SELECT entity_key, target_period, challenger - comparator AS difference FROM ({_PAIRED})),
e AS (SELECT entity_key, row_number() OVER (ORDER BY entity_key) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT entity_key FROM d)),
t AS (SELECT replicate, {{DRAW}} AS rank, count(*) AS times FROM e, (SELECT unnest(range(0, {{R}})) AS replicate) GROUP BY ALL),
m AS (SELECT replicate, avg(mean) AS balanced, count(*) AS periods FROM (SELECT replicate, target_period, sum(times * difference) / sum(times) AS mean FROM t JOIN e USING (rank) JOIN d USING (entity_key) GROUP BY ALL) GROUP BY ALL)"""
_INTERVAL = "round(quantile_cont(balanced, 0.025), 6) AS lower, round(quantile_cont(balanced, 0.5), 6) AS median, round(quantile_cont(balanced, 0.975), 6) AS upper"


def bootstrap_sql(final: str, replicates: int) -> str:
    return "SELECT * FROM (" + _DRAWS.replace("WITH_PREFIX", "WITH").format(R=replicates, DRAW=draw_sql()) + "\n" + final + ")"


@register(bootstrap_sql(f"SELECT count(*) AS retained, {_INTERVAL}, 200 - count(*) AS skipped FROM m WHERE periods = (SELECT count(DISTINCT target_period) FROM d)", 200), "errors")
def bootstrap_clustered_skip(spark, sf):
    return six(resample.clustered_skip(differences(spark, sf)))


@register(bootstrap_sql(f"SELECT count(*) AS retained, {_INTERVAL} FROM m", 200), "errors")
def bootstrap_clustered_drop(spark, sf):
    return six(resample.clustered_drop(differences(spark, sf)))


@register(bootstrap_sql(f"SELECT count(*) AS retained, CAST(max(replicate) + 1 AS BIGINT) AS attempts, {_INTERVAL} FROM (SELECT *, row_number() OVER (ORDER BY replicate) AS place FROM m WHERE periods = (SELECT count(DISTINCT target_period) FROM d)) WHERE place <= 200", 400), "errors")
def bootstrap_clustered_redraw(spark, sf):
    return six(resample.clustered_redraw(differences(spark, sf)))


@register(bootstrap_sql(f"SELECT count(*) AS retained, {_INTERVAL} FROM (SELECT replicate, sum(times * own) / sum(times) AS balanced FROM t JOIN e USING (rank) JOIN (SELECT entity_key, avg(difference) AS own FROM d GROUP BY ALL) USING (entity_key) GROUP BY ALL)", 200), "errors")
def bootstrap_paired(spark, sf):
    return six(resample.paired_mean(differences(spark, sf)))


_COVERED = f"SELECT target_period, model, count(*) AS rows, count(band_lower) AS available, count(*) - count(band_lower) AS unavailable, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered)::DOUBLE / nullif(count(band_lower), 0), 6) AS coverage, round(avg(2 * radius), 6) AS mean_width FROM ({_BANDED}) GROUP BY ALL HAVING count(band_lower) > 0"
view("covered_bands", ("errors",), _COVERED)
view("binomial_sides", ("covered_bands",), "SELECT *, available AS n, unnest(['lower', 'upper']) AS side, unnest([covered, covered + 1]) AS k, unnest([0.025::DOUBLE, 0.975::DOUBLE]) AS wanted FROM covered_bands")
view("bisections", ("binomial_sides",), f"""SELECT 0 AS step, target_period, model, n, side, k, wanted, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM binomial_sides WHERE k BETWEEN 1 AND n UNION ALL
SELECT step + 1, target_period, model, n, side, k, wanted, CASE WHEN tail < wanted THEN mid ELSE lo END, CASE WHEN tail < wanted THEN hi ELSE mid END FROM (
SELECT b.step, b.target_period, b.model, b.n, b.side, b.k, b.wanted, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid, sum(exp(lgamma(b.n + 1) - lgamma(i + 1) - lgamma(b.n - i + 1) + i * ln((b.lo + b.hi) / 2) + (b.n - i) * ln(1 - (b.lo + b.hi) / 2))) AS tail
FROM bisections b, LATERAL (SELECT unnest(range(b.k, b.n + 1)) AS i) WHERE b.step < 40 GROUP BY ALL)""")


@register("SELECT c.*, round(coalesce(a.lo, 0), 6) AS lower, round(coalesce(b.lo, 1), 6) AS upper FROM covered_bands c LEFT JOIN bisections a ON a.step = 40 AND a.side = 'lower' AND a.target_period = c.target_period AND a.model = c.model LEFT JOIN bisections b ON b.step = 40 AND b.side = 'upper' AND b.target_period = c.target_period AND b.model = c.model", "covered_bands", "bisections")
def coverage_intervals(spark, sf):
    return six(intervals.clopper_pearson(band_coverage(spark, sf).where("available > 0"), "covered", "available"))


# ridge
KEPT = ("entity_key", "feature_period", "target_period", "target_log", "first_observed")
#: Nested groups of features, and revised ones that leave one feature out.
GROUPS = {"current": ["current_log"], "history": ["current_log", "previous_log", "change_log", "missing_previous_log", "missing_change_log"], "volume": [*panel.LOG_INPUTS[:5], "missing_previous_log", "missing_change_log"], "strata": [*panel.LOG_INPUTS[:9], *panel.FEATURES[11:]], "all": FEATURES}
GROUPS |= {f"{name} less change": [c for c in GROUPS[name] if c not in ("change_log", "missing_change_log")] for name in ("volume", "all")}
#: Training targets of the replay of the last period: its sensitivities leave one year out each.
REPLAYS = {"primary": 0, "without 1997": 1997, "without 1998": 1998}


def fitting_rows(spark, sf):
    """Panel rows whose target is known, once each; a fold's training rows are told by their target periods."""
    return panel.feature_matrix(the_panel(spark, sf).where("analytic_eligible"), *KEPT)


def rolling_fit(spark, sf, window=None):
    """Predictors, fits by evaluation period from all earlier targets (or the last `window` periods), and their sums."""
    rows, periods = fitting_rows(spark, sf), sorted(r.eval_period for r in eval_periods(spark, sf).collect())
    earlier = lambda cells: {e: [c for c in cells if (e - window if window else -1) <= int(c) < e] for e in periods}
    return (rows, *models.fit_cells(rows, FEATURES, "target_log", F.col("target_period"), earlier))


def ridge(spark, sf, alphas, window=None, groups=None):
    """Fitted parameters, and predictions of each fold's own period."""
    rows, fits, _ = rolling_fit(spark, sf, window)
    fitted = models.parameters(spark, fits, FEATURES, alphas, groups)
    return fitted, models.predictions(rows.withColumn("eval_period", F.col("target_period")), fitted, FEATURES)


_FOLDS = f"""SELECT e.eval_period, CASE WHEN p.target_period = e.eval_period THEN 'evaluate' ELSE 'train' END AS role, p.entity_key, p.target_period, p.target_log, p.first_observed, CAST(1 + (4 * (row_number() OVER (PARTITION BY e.eval_period, p.target_period ORDER BY log1p_expected, entity_key) - 1)) // count(*) OVER (PARTITION BY e.eval_period, p.target_period) AS INTEGER) AS quartile, {", ".join(f"p.{c}::DOUBLE AS {c}" for c in FEATURES)}
FROM (SELECT DISTINCT target_period AS eval_period FROM panel WHERE target_period BETWEEN 1998 AND 2000) e JOIN panel p ON p.analytic_eligible AND p.target_period <= e.eval_period"""
_RECENT = _FOLDS + " AND p.target_period >= e.eval_period - 3"
_REPLAY = f"""SELECT r.eval_period, CASE WHEN p.target_period = 2000 THEN 'evaluate' ELSE 'train' END AS role, p.entity_key, p.target_period, p.target_log, p.first_observed, CAST(1 + (4 * (row_number() OVER (PARTITION BY r.eval_period, p.target_period ORDER BY log1p_expected, entity_key) - 1)) // count(*) OVER (PARTITION BY r.eval_period, p.target_period) AS INTEGER) AS quartile, {", ".join(f"p.{c}::DOUBLE AS {c}" for c in FEATURES)}
FROM (VALUES {", ".join(f"({k}, {out})" for k, out in enumerate(REPLAYS.values()))}) r(eval_period, left_out) JOIN panel p ON p.analytic_eligible AND p.target_period <= 2000 AND p.target_period <> r.left_out"""


def ridge_views(name: str, folds_sql: str, alphas, groups=None, features=tuple(FEATURES), reads=("panel",)) -> None:
    """Views <name>_folds, _long, _stats, _z, _weights and _predicted: medians, moments and Gauss-Jordan elimination in SQL."""
    members = [(g, features.index(c)) for g, own in (groups or {"all": features}).items() for c in own]
    names = ", ".join(f"'{c}'" for c in features)
    view(f"{name}_folds", reads, folds_sql)
    view(f"{name}_long", (f"{name}_folds",), f"SELECT eval_period, role, entity_key, target_period, target_log, unnest(range({len(features)})) AS i, unnest([{names}]) AS feature, unnest([{', '.join(features)}]) AS value FROM {name}_folds")
    view(f"{name}_medians", (f"{name}_long",), f"SELECT eval_period, i, coalesce(quantile_cont(value, 0.5), 0) AS median FROM {name}_long WHERE role = 'train' GROUP BY ALL")
    view(f"{name}_stats", (f"{name}_long", f"{name}_medians"), f"SELECT eval_period, i, feature, median, mean, CASE WHEN deviation > 1e-9 THEN deviation ELSE 1 END AS scale, n FROM (SELECT l.eval_period, l.i, l.feature, any_value(m.median) AS median, avg(coalesce(l.value, m.median)) AS mean, stddev_pop(coalesce(l.value, m.median)) AS deviation, count(*) AS n FROM {name}_long l JOIN {name}_medians m USING (eval_period, i) WHERE role = 'train' GROUP BY ALL)")
    view(f"{name}_z", (f"{name}_long", f"{name}_stats"), f"SELECT l.eval_period, l.role, l.entity_key, l.target_period, l.target_log, l.i, (coalesce(l.value, s.median) - s.mean) / s.scale AS z FROM {name}_long l JOIN {name}_stats s USING (eval_period, i)")
    view(f"{name}_means", (f"{name}_folds",), f"SELECT eval_period, avg(target_log) AS intercept FROM {name}_folds WHERE role = 'train' GROUP BY ALL")
    view(f"{name}_gram", (f"{name}_z", f"{name}_means"), f"""SELECT a.eval_period, a.i, b.i AS j, sum(a.z * b.z) AS v FROM {name}_z a JOIN {name}_z b USING (eval_period, role, entity_key, target_period) WHERE role = 'train' GROUP BY ALL
    UNION ALL SELECT z.eval_period, z.i, 99, sum(z.z * (z.target_log - m.intercept)) FROM {name}_z z JOIN {name}_means m USING (eval_period) WHERE role = 'train' GROUP BY ALL""")
    view(f"{name}_system", (f"{name}_gram",), f"""SELECT g.eval_period, a.alpha, m.grp, g.i, g.j, g.v + CASE WHEN g.i = g.j THEN a.alpha ELSE 0 END AS v FROM {name}_gram g, (VALUES {", ".join(f"({a}::DOUBLE)" for a in alphas)}) a(alpha), (VALUES {", ".join(f"('{g}', {i})" for g, i in members)}) m(grp, i)
    WHERE g.i = m.i AND (g.j = 99 OR (m.grp, g.j) IN (VALUES {", ".join(f"('{g}', {i})" for g, i in members)}))""")
    view(f"{name}_steps", (f"{name}_system",), f"""SELECT 0 AS k, eval_period, alpha, grp, i, j, v FROM {name}_system UNION ALL SELECT k + 1, eval_period, alpha, grp, i, j, CASE WHEN akk IS NULL THEN v WHEN i = k THEN v / akk ELSE v - aik * akj / akk END FROM (
    SELECT *, max(v) FILTER (j = k) OVER (PARTITION BY eval_period, alpha, grp, i) AS aik, max(v) FILTER (i = k) OVER (PARTITION BY eval_period, alpha, grp, j) AS akj, max(v) FILTER (i = k AND j = k) OVER (PARTITION BY eval_period, alpha, grp) AS akk FROM {name}_steps WHERE k < {len(features)})""")
    view(f"{name}_weights", (f"{name}_steps", f"{name}_stats", f"{name}_means"), f"SELECT w.eval_period, w.alpha, w.grp, w.i, s.feature, w.v AS weight, s.median, s.mean, s.scale, m.intercept, s.n FROM {name}_steps w JOIN {name}_stats s USING (eval_period, i) JOIN {name}_means m USING (eval_period) WHERE w.k = {len(features)} AND w.j = 99")
    view(f"{name}_predicted", (f"{name}_weights", f"{name}_z", f"{name}_folds"), f"""SELECT f.eval_period, f.entity_key, f.target_period, f.target_log, f.first_observed, f.quartile, q.alpha, q.grp, q.predicted_log FROM {name}_folds f JOIN (SELECT z.eval_period, z.entity_key, z.target_period, w.alpha, w.grp, any_value(w.intercept) + sum(w.weight * z.z) AS predicted_log FROM {name}_z z JOIN {name}_weights w USING (eval_period, i) WHERE role = 'evaluate' GROUP BY ALL) q USING (eval_period, entity_key, target_period) WHERE f.role = 'evaluate'""")


ridge_views("ridge", _FOLDS, [10.0])
ridge_views("grid", _FOLDS, ALPHAS)
ridge_views("recent", _RECENT, [10.0])
ridge_views("ablation", _FOLDS, [1.0], GROUPS)
ridge_views("replay", _REPLAY, [10.0])


@register('SELECT eval_period AS fold, alpha, grp AS "group", feature, round(weight, 6) AS weight, round(median, 6) AS median, round(mean, 6) AS mean, round(scale, 6) AS scale, round(intercept, 6) AS intercept, n AS train_rows FROM ridge_weights', "ridge_weights")
def ridge_parameters(spark, sf):
    return six(ridge(spark, sf, [10.0])[0], "alpha")


_RIDGE = "SELECT entity_key, target_period, round(target_log, 6) AS target_log, round(predicted_log, 6) AS predicted_log FROM "


@register(_RIDGE + "ridge_predicted", "ridge_predicted")
def ridge_predictions(spark, sf):
    return six(ridge(spark, sf, [10.0])[1].select("entity_key", "target_period", "target_log", "predicted_log"))


_SCORES = "SELECT {by} AS {name}, avg(mean) AS balanced, sum(total) / sum(rows) AS pooled, sum(rows)::BIGINT AS rows, count(*) AS periods FROM (SELECT {by}, target_period, avg(abs(predicted_log - target_log)) AS mean, sum(abs(predicted_log - target_log)) AS total, count(*) AS rows FROM {table} GROUP BY ALL) GROUP BY ALL"


@register("SELECT alpha, 'ridge' AS model, round(balanced, 6) AS balanced, round(pooled, 6) AS pooled, rows, periods FROM (" + _SCORES.format(by="alpha", name="alpha", table="grid_predicted") + ")", "grid_predicted")
def alpha_scores(spark, sf):
    return six(scores(spark, sf), "alpha")


def scores(spark, sf):
    errors = ridge(spark, sf, ALPHAS)[1].withColumn("absolute_log", F.abs(F.col("predicted_log") - F.col("target_log"))).withColumn("model", F.lit("ridge"))
    return evaluate.balanced_mean(errors, "alpha")


@register("SELECT max(alpha) AS alpha, round(arg_max(balanced, alpha), 6) AS balanced FROM (SELECT *, min(balanced) OVER () AS best FROM (" + _SCORES.format(by="alpha", name="alpha", table="grid_predicted") + ")) WHERE balanced <= best * 1.01::DOUBLE", "grid_predicted")
def selected_alpha(spark, sf):
    return six(models.select_alpha(scores(spark, sf)), "alpha")


@register(_RIDGE + "recent_predicted", "recent_predicted")
def recent_window_ridge(spark, sf):
    return six(ridge(spark, sf, [10.0], 3)[1].select("entity_key", "target_period", "target_log", "predicted_log"))


@register("SELECT model, round(balanced, 6) AS balanced, round(pooled, 6) AS pooled, rows, periods FROM (" + _SCORES.format(by="grp", name="model", table="ablation_predicted") + ")", "ablation_predicted")
def group_ablation(spark, sf):
    """Groups of features on identical rows, from one matrix of moments."""
    errors = ridge(spark, sf, [1.0], groups=GROUPS)[1].withColumn("absolute_log", F.abs(F.col("predicted_log") - F.col("target_log"))).withColumn("model", F.col("group"))
    return six(evaluate.balanced_mean(errors))


@register("SELECT w.eval_period AS fold, w.feature, round(t.z, 6) AS z_train, round(e.z, 6) AS z_evaluate, round(w.weight * (e.z - t.z), 6) AS contribution FROM ridge_weights w JOIN (SELECT eval_period, i, avg(z) AS z FROM ridge_z WHERE role = 'train' GROUP BY ALL) t USING (eval_period, i) JOIN (SELECT eval_period, i, avg(z) AS z FROM ridge_z WHERE role = 'evaluate' GROUP BY ALL) e USING (eval_period, i)", "ridge_weights", "ridge_z")
def mean_shift_contributions(spark, sf):
    _, fits, sums = rolling_fit(spark, sf)
    return six(models.contributions(spark, sums, fits, 10.0, lambda fold: [str(fold)]))


_COMPARED = """SELECT entity_key, target_period, model, target_log, predicted_log FROM predictions UNION ALL SELECT entity_key, target_period, 'ridge', target_log, predicted_log FROM ridge_predicted UNION ALL SELECT entity_key, target_period, 'ridge_recent', target_log, predicted_log FROM recent_predicted"""
view("compared_models", ("predictions", "ridge_predicted", "recent_predicted"), _COMPARED)


@T.saved
def compared_models(spark, sf):
    """The methods without a matrix and two ridge models, long."""
    base = predictions(spark, sf).select("entity_key", "target_period", "model", "target_log", "predicted_log")
    ridges = [ridge(spark, sf, [10.0], window)[1].select("entity_key", "target_period", F.lit(name).alias("model"), "target_log", "predicted_log") for name, window in (("ridge", None), ("ridge_recent", 3))]
    return base.unionByName(ridges[0]).unionByName(ridges[1])


_MODEL_RADIUS = "SELECT target_period, model, CASE WHEN rows >= 30 THEN ae END AS radius FROM (SELECT *, row_number() OVER (PARTITION BY target_period, model ORDER BY ae) AS place, count(*) OVER (PARTITION BY target_period, model) AS rows FROM (SELECT *, abs(predicted_log - target_log) AS ae FROM compared_models)) WHERE place = least(rows, ((rows + 1) * 80 + 99) // 100)"
_MODEL_BANDS = f"SELECT c.*, r.radius FROM compared_models c LEFT JOIN ({_MODEL_RADIUS}) r ON r.model = c.model AND r.target_period = c.target_period - 1 WHERE c.target_period > 1998"


@register(f"SELECT entity_key, target_period, model, round(target_log, 6) AS target_log, round(predicted_log, 6) AS predicted_log, round(predicted_log - radius, 6) AS log_lower, round(predicted_log + radius, 6) AS log_upper, target_log BETWEEN predicted_log - radius AND predicted_log + radius AS covered FROM ({_MODEL_BANDS})", "compared_models")
def comparison_predictions(spark, sf):
    """All methods with bands from their errors one year before; the first year only warms them up."""
    rows = compared_models(spark, sf).withColumn("absolute_log", F.abs(F.col("predicted_log") - F.col("target_log")))
    banded_rows = evaluate.with_bands(rows, evaluate.band_radius(rows, "target_period", "model")).where("target_period > 1998")
    r, p = F.col("radius"), F.col("predicted_log")
    return banded_rows.select("entity_key", "target_period", "model", r6("target_log"), r6("predicted_log"), r6(p - r, "log_lower"), r6(p + r, "log_upper"), "covered")


_RUN = "CASE eval_period " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(REPLAYS)) + " END"


def replays(spark, sf):
    """Each replay is a fold, told by its number: all targets before the last period but one year, and the last period's rows."""
    rows = panel.with_quartile(the_panel(spark, sf).where("analytic_eligible AND target_period <= 2000"), "log1p_expected", "target_period")
    rows = panel.feature_matrix(rows, *KEPT, "quartile")
    train = lambda cells: {k: [c for c in cells if int(c) < T.LAST_PERIOD and int(c) != out] for k, out in enumerate(REPLAYS.values())}
    fitted = models.parameters(spark, models.fit_cells(rows, FEATURES, "target_log", F.col("target_period"), train)[0], FEATURES, [10.0])
    runs = F.explode(F.array(*[F.lit(k) for k in range(len(REPLAYS))]))
    name = F.element_at(F.array(*[F.lit(n) for n in REPLAYS]), F.col("eval_period") + 1)
    return models.predictions(rows.where(F.col("target_period") == T.LAST_PERIOD).withColumn("eval_period", runs), fitted, FEATURES).withColumn("sensitivity", name)


@register(f"SELECT entity_key, target_period, {_RUN} AS sensitivity, round(target_log, 6) AS target_log, round(predicted_log, 6) AS predicted_log FROM replay_predicted", "replay_predicted")
def replay_predictions(spark, sf):
    """Fit once on targets before the last period, evaluate that period; and again without each of two training years."""
    return six(replays(spark, sf).select("entity_key", "target_period", "sensitivity", "target_log", "predicted_log"))


_STRATA = "SELECT *, unnest(['all', 'quartile ' || quartile, CASE WHEN first_observed THEN 'first observed' ELSE 'established' END, CASE WHEN missing THEN 'any predictor missing' ELSE 'no predictor missing' END]) AS stratum FROM (SELECT p.*, f." + " IS NULL OR f.".join(panel.LOG_INPUTS) + " IS NULL AS missing FROM replay_predicted p JOIN replay_folds f USING (eval_period, entity_key, target_period))"


@register(f"SELECT {_RUN} AS sensitivity, stratum, count(*) AS rows, round(avg(abs(predicted_log - target_log)), 6) AS mae, round(avg(predicted_log - target_log), 6) AS bias, round(CASE WHEN count(*) > 1 AND min(predicted_log) < max(predicted_log) THEN regr_slope(target_log, predicted_log) END, 6) AS slope FROM ({_STRATA}) GROUP BY ALL", "replay_predicted", "replay_folds")
def replay_diagnostics(spark, sf):
    """The replays' errors by volume quartile, by entry and by missing predictors."""
    missing = F.exists(F.array(*panel.LOG_INPUTS), lambda c: c.isNull())
    strata = F.array(F.lit("all"), F.concat(F.lit("quartile "), "quartile"), F.when(F.col("first_observed"), "first observed").otherwise("established"), F.when(missing, "any predictor missing").otherwise("no predictor missing"))
    errors = replays(spark, sf).withColumns({"error": F.col("predicted_log") - F.col("target_log"), "stratum": F.explode(strata)})
    return six(errors.groupBy("sensitivity", "stratum").agg(F.count("*").alias("rows"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"), F.regr_slope("target_log", "predicted_log").alias("slope")))


# gates
_C, _P, _M = gates.CANDIDATE, gates.POLICY, gates.PROMOTION
_YEARLY = "SELECT target_period, model, avg(absolute_log) AS mae, avg(absolute_ratio) AS ratio, avg(signed_log) AS signed, quantile_cont(absolute_log, 0.9) AS p90, count(*) AS rows FROM errors {where} GROUP BY ALL"
_VERSUS = "SELECT y.*, r.mae AS ref FROM ({t}) y JOIN ({t}) r ON r.target_period = y.target_period AND r.model = 'persistence' WHERE y.model <> 'persistence'"
_WORSE = "CASE WHEN {r} = 0 THEN CASE WHEN {c} = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE {c} / {r} - 1 END"


def failed_sql(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({v}, false) THEN '{k}' END" for k, v in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


_RULES = {"skill": f"skill >= {_C['skill']}", "improved": f"improved >= {_C['improved']}", "worst": f"worst <= {_C['worst']}", "low_rows": f"low_rows >= {_C['low_rows']}", "low_worsening": f"low_worsening <= {_C['low_worsening']}"}


@register(
    f"""SELECT model, round(skill, 6) AS skill, improved, round(worst, 6) AS worst, round(low_worsening, 6) AS low_worsening, low_rows, {failed_sql(_RULES)} AS failed, {failed_sql(_RULES)} = '' AS passed FROM (
    SELECT model, coalesce(1 - avg(mae) / nullif(avg(ref), 0), 0) AS skill, count(*) FILTER (mae < ref) AS improved, max({_WORSE.format(c='mae', r='ref')}) AS worst FROM ({_VERSUS.format(t=_YEARLY.format(where=''))}) GROUP BY model) JOIN (
    SELECT model, {_WORSE.format(c='avg(mae)', r='avg(ref)')} AS low_worsening, min(rows) AS low_rows FROM ({_VERSUS.format(t=_YEARLY.format(where='WHERE quartile = 1'))}) GROUP BY model) USING (model)""",
    "errors",
)
def gate_candidate(spark, sf):
    return six(gates.candidate(predictions(spark, sf)))


def interval_views(name: str, table: str, *keys: str) -> None:
    """View <name>: exact 95 % bounds of covered / available of each row of the view `table` with these keys, by bisection."""
    k = ", ".join(keys)
    view(f"{name}_sides", (table,), f"SELECT {k}, available AS n, unnest(['lower', 'upper']) AS side, unnest([covered, covered + 1]) AS k, unnest([0.025::DOUBLE, 0.975::DOUBLE]) AS wanted FROM {table} WHERE available > 0")
    view(f"{name}_halves", (f"{name}_sides",), f"""SELECT 0 AS step, {k}, n, side, k, wanted, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM {name}_sides WHERE k BETWEEN 1 AND n UNION ALL
    SELECT step + 1, {k}, n, side, k, wanted, CASE WHEN tail < wanted THEN mid ELSE lo END, CASE WHEN tail < wanted THEN hi ELSE mid END FROM (
    SELECT b.step, {", ".join(f"b.{x}" for x in keys)}, b.n, b.side, b.k, b.wanted, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid, sum(exp(lgamma(b.n + 1) - lgamma(i + 1) - lgamma(b.n - i + 1) + i * ln((b.lo + b.hi) / 2) + (b.n - i) * ln(1 - (b.lo + b.hi) / 2))) AS tail
    FROM {name}_halves b, LATERAL (SELECT unnest(range(b.k, b.n + 1)) AS i) WHERE b.step < 40 GROUP BY ALL)""")
    view(name, (f"{name}_sides", f"{name}_halves"), f"SELECT {k}, coalesce(max(h.lo) FILTER (side = 'lower'), 0) AS lower, coalesce(max(h.lo) FILTER (side = 'upper'), 1) AS upper FROM {name}_sides s LEFT JOIN (SELECT * FROM {name}_halves WHERE step = 40) h USING ({k}, side) GROUP BY ALL")


def policy_bands(spark, sf):
    return banded(spark, sf).where("target_period > 1998")


view("banded", ("errors",), _BANDED)
view("promotion_band", ("banded",), "SELECT 1 AS one, count(band_lower) FILTER (model = 'historical_mean') AS available, count(*) FILTER (covered AND model = 'historical_mean') AS covered, avg(band_upper - band_lower) FILTER (model = 'historical_mean') AS width, avg(band_upper - band_lower) FILTER (model = 'persistence') AS ref_width FROM banded WHERE target_period = 2000")
interval_views("promotion_exact", "promotion_band", "one")
_AVG = "avg({v}) FILTER (model = '{m}'{w})"
_ONE = ", ".join(f"{_AVG.format(v=v, m=m, w=w)} AS {n}" for n, v, m, w in (("mae", "absolute_log", "historical_mean", ""), ("ref", "absolute_log", "persistence", ""), ("s", "signed_log", "historical_mean", ""), ("ref_s", "signed_log", "persistence", ""), ("low", "absolute_log", "historical_mean", " AND quartile = 1"), ("ref_low", "absolute_log", "persistence", " AND quartile = 1")))
_POINT = {"skill": f"skill >= {_M['skill']}", "interval": "interval_upper < 0", "bias": f"abs(s) <= {_M['bias']}", "bias_to_baseline": "abs(s) <= abs(ref_s)", "low_rows": f"low_rows >= {_M['low_rows']}", "low_worsening": _WORSE.format(c="low", r="ref_low") + f" <= {_M['low_worsening']}"}
_BAND = {"availability": "available > 0", "coverage": f"{_M['nominal']}::DOUBLE BETWEEN exact_lower AND exact_upper", "width": _WORSE.format(c="width", r="ref_width") + f" + 1 <= {_M['width']}"}
_REPLAYED = f"""(SELECT quantile_cont(balanced, 0.975) AS interval_upper FROM (SELECT replicate, sum(times * difference) / sum(times) AS balanced FROM pt JOIN pe USING (rank) JOIN pd USING (entity_key) GROUP BY ALL))"""
view("pd", ("errors",), f"SELECT entity_key, challenger - comparator AS difference FROM ({_PAIRED}) WHERE target_period = 2000")
view("pe", ("pd",), "SELECT entity_key, row_number() OVER (ORDER BY entity_key) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT entity_key FROM pd)")
view("pt", ("pe",), "SELECT replicate, " + draw_sql() + " AS rank, count(*) AS times FROM pe, (SELECT unnest(range(0, 200)) AS replicate) GROUP BY ALL")


@register(
    f"""SELECT round(skill, 6) AS skill, round(interval_upper, 6) AS interval_upper, round(exact_lower, 6) AS exact_lower, round(exact_upper, 6) AS exact_upper, point_failed, band_failed, point_failed = '' AS point_promoted, band_failed = '' AS band_promoted, CASE WHEN point_failed = '' THEN 'historical_mean' ELSE 'persistence' END AS displayed, point_failed = '' AND band_failed = '' AS released FROM (
    SELECT *, {failed_sql(_POINT)} AS point_failed, {failed_sql(_BAND)} AS band_failed FROM (SELECT *, coalesce(1 - mae / nullif(ref, 0), 0) AS skill FROM (SELECT {_ONE}, count(*) FILTER (model = 'historical_mean' AND quartile = 1) AS low_rows FROM errors WHERE target_period = 2000), {_REPLAYED}, promotion_band LEFT JOIN (SELECT one, lower AS exact_lower, upper AS exact_upper FROM promotion_exact) USING (one)))""",
    "errors", "pd", "pe", "pt", "promotion_band", "promotion_exact",
)
def gate_promotion(spark, sf):
    """Whether the historical mean's points and bands of the last period may be shown."""
    return six(gates.promotion(predictions(spark, sf), banded(spark, sf), T.LAST_PERIOD, "historical_mean"))


CANDIDATES = ("adjusted_persistence", "neutral")
view("policy_errors", ("errors",), "SELECT * FROM errors WHERE target_period > 1998")
_HIDDEN = "(group_field = 'public' AND group_value <> 'true')"
_APPLIED = f"(rows >= {_P['group_rows']} AND NOT {_HIDDEN})"
_GROUPS_OF = _GROUPED.replace("FROM errors", "FROM policy_errors")
_MEANS = f"SELECT target_period, group_field, coalesce(group_value, 'Unknown') AS group_value, model, count(*) AS rows, avg(absolute_log) AS mean FROM ({_GROUPS_OF}) GROUP BY ALL"
view("group_cells", ("policy_errors",), f"SELECT *, {_APPLIED} AS applied, CASE WHEN {_APPLIED} THEN mean <= ref * (1 + {_P['group_worsening']}) END AS passed, CASE WHEN {_HIDDEN} THEN 'not eligible' WHEN {_APPLIED} THEN 'enough rows' ELSE 'too few rows' END AS reason FROM (SELECT c.*, r.mean AS ref FROM ({_MEANS}) c JOIN ({_MEANS}) r ON r.model = 'persistence' AND r.target_period = c.target_period AND r.group_field = c.group_field AND r.group_value = c.group_value WHERE c.model <> 'persistence')")


@register("SELECT model, target_period, group_field, group_value, rows, round(mean, 6) AS mean, round(ref, 6) AS ref, applied, passed, reason FROM group_cells", "group_cells")
def gate_groups(spark, sf):
    """Every group of the policy's periods against the baseline."""
    return six(policy_groups(spark, sf))


def policy_groups(spark, sf):
    return gates.group_cells(evaluate.group_summaries(predictions(spark, sf).where("target_period > 1998"), groups()))


_BAND_GROUPS = f"SELECT *, unnest(['all', 'quartile', 'earlier', 'missing', 'first', 'public']) AS group_field, unnest(['all', quartile::VARCHAR, {_BUCKET}, any_missing::VARCHAR, first_observed::VARCHAR, public_forecast_eligible::VARCHAR]) AS group_value FROM banded WHERE target_period > 1998"
view("band_groups", ("banded",), f"SELECT target_period, model, group_field, coalesce(group_value, 'Unknown') AS group_value, count(*) AS rows, count(band_lower) AS available, count(*) FILTER (covered) AS covered, avg(band_upper - band_lower) AS width FROM ({_BAND_GROUPS}) GROUP BY ALL")
interval_views("band_exact", "band_groups", "target_period", "model", "group_field", "group_value")
view("band_cells", ("band_groups", "band_exact"), f"SELECT *, {_APPLIED} AS applied, CASE WHEN {_APPLIED} THEN coalesce({_P['nominal']}::DOUBLE BETWEEN lower AND upper, false) END AS passed FROM band_groups LEFT JOIN band_exact USING (target_period, model, group_field, group_value)")


@register("SELECT target_period, model, group_field, group_value, rows, available, covered, round(width, 6) AS width, round(lower, 6) AS lower, round(upper, 6) AS upper, applied, passed FROM band_cells", "band_cells")
def gate_bands(spark, sf):
    """Coverage of every period and group of the policy with exact intervals."""
    return six(gates.band_cells(policy_bands(spark, sf), groups()))


_BAND_MODELS = "SELECT model, bool_and(NOT (group_field = 'all' AND (available < rows OR NOT applied))) AS availability, coalesce(bool_and(passed) FILTER (applied), true) AS coverage, avg(width) FILTER (group_field = 'all') AS width, bool_and(group_field <> 'all' OR width IS NOT NULL) AS complete FROM band_cells GROUP BY model"
view("band_checks", ("band_cells",), f"SELECT model, unnest(['bands everywhere', 'nominal coverage', 'narrow bands']) AS criterion, unnest([availability, coverage, coalesce(complete AND ref_complete AND width <= ref * {_P['width']}, false)]) AS passed FROM ({_BAND_MODELS}), (SELECT width AS ref, complete AS ref_complete FROM ({_BAND_MODELS}) WHERE model = 'persistence')")


def _uppers() -> str:
    """Upper bounds of the bootstrap and shares of large worsening of each candidate against the baseline."""
    parts = []
    for m in CANDIDATES:
        own = f"SELECT entity_key, target_period, max(absolute_log) FILTER (model = '{m}') AS challenger, max(absolute_log) FILTER (model = 'persistence') AS comparator FROM policy_errors GROUP BY ALL"
        final = f"SELECT '{m}' AS model, (SELECT quantile_cont(balanced, 0.975) FROM m WHERE periods = (SELECT count(DISTINCT target_period) FROM d)) AS upper, (SELECT avg(s) FROM (SELECT target_period, avg((difference > {_P['large']})::INTEGER) AS s FROM d GROUP BY ALL)) AS large"
        parts.append(bootstrap_sql(final, 200).replace(_PAIRED, own))
    return " UNION ALL ".join(parts)


_BY_MODEL = f"SELECT model, avg(mae) AS log, avg(ratio) AS ratio, abs(avg(signed)) AS bias, max(abs(signed)) AS year_bias, avg(p90) AS tail, count(*) FILTER (mae < ref) AS improved, bool_and(mae <= ref * (1 + {_P['year_worsening']})) AS every FROM (SELECT y.*, r.mae AS ref FROM ({{t}}) y JOIN ({{t}}) r ON r.target_period = y.target_period AND r.model = 'persistence') GROUP BY model".format(t=_YEARLY.format(where="").replace("FROM errors", "FROM policy_errors"))
_CHECKS = {
    "mean error": f"log <= b_log * (1 - {_P['improvement']})", "mean error of the history": "log <= h_log", "mean error of ratios": "ratio <= b_ratio", "interval of the difference": "upper < 0", "better years": f"improved >= {_P['improved']}", "no much worse year": "every",
    "mean bias": f"bias <= {_P['bias']}", "bias of each year": f"year_bias <= {_P['year_bias']}", "ninth decile": f"tail <= b_tail * {_P['tail']}", "share of much worse rows": f"large <= {_P['large_share']}", "every group": "coalesce(groups_, true)",
}
view("point_checks", ("policy_errors", "group_cells"), f"""SELECT model, log AS mae, unnest([{", ".join(f"'{k}'" for k in _CHECKS)}]) AS criterion, unnest([{", ".join(f"coalesce({v}, false)" for v in _CHECKS.values())}]) AS passed FROM ({_BY_MODEL}) JOIN ({_uppers()}) USING (model)
LEFT JOIN (SELECT model, coalesce(bool_and(passed) FILTER (applied), true) AS groups_ FROM group_cells GROUP BY model) USING (model), (SELECT log AS b_log, ratio AS b_ratio, tail AS b_tail FROM ({_BY_MODEL}) WHERE model = 'persistence'), (SELECT log AS h_log FROM ({_BY_MODEL}) WHERE model = 'historical_mean')""")


@T.saved
def policy_points(spark, sf):
    return gates.point_checks(predictions(spark, sf).where("target_period > 1998"), policy_groups(spark, sf), CANDIDATES)


def policy_band_checks(spark, sf):
    return gates.band_checks(gates.band_cells(policy_bands(spark, sf), groups()))


@register("SELECT model, criterion, passed FROM point_checks UNION ALL SELECT model, criterion, passed FROM band_checks", "point_checks", "band_checks")
def gate_policy(spark, sf):
    """The eleven point checks of each candidate and the three band checks of each model."""
    return policy_points(spark, sf).select("model", "criterion", "passed").unionByName(policy_band_checks(spark, sf))


@register(
    f"""SELECT selected, point_selected, point_selected AND coalesce((SELECT bool_and(passed) FROM band_checks WHERE model = selected), false) AS band_selected FROM (SELECT coalesce(max(model) FILTER (place = 1), 'persistence') AS selected, count(*) > 0 AS point_selected FROM (
    SELECT model, row_number() OVER (ORDER BY mae, list_position([{", ".join(f"'{m}'" for m in CANDIDATES)}], model)) AS place FROM (SELECT model, any_value(mae) AS mae, bool_and(passed) AS passed FROM point_checks GROUP BY model) WHERE passed))""",
    "point_checks", "band_checks",
)
def policy_selection(spark, sf):
    """The candidate with the lowest error that passes all point checks, else the baseline; and whether its bands pass."""
    return gates.selection(policy_points(spark, sf), policy_band_checks(spark, sf), CANDIDATES)


_COLUMNS = [*panel.LOG_INPUTS, "any"]
_NULL = {c: f"{c} IS NULL" for c in panel.LOG_INPUTS} | {"any": " OR ".join(f"{c} IS NULL" for c in panel.LOG_INPUTS)}


@register("SELECT feature, train::BIGINT AS train, evaluate::BIGINT AS evaluate FROM (SELECT " + ", ".join(f'count(*) FILTER (target_period < 2000 AND ({v})) AS "a_{c}", count(*) FILTER (target_period = 2000 AND ({v})) AS "b_{c}"' for c, v in _NULL.items()) + " FROM panel WHERE analytic_eligible AND target_period <= 2000), LATERAL (VALUES " + ", ".join(f"""('{c}', "a_{c}", "b_{c}")""" for c in _NULL) + ") v(feature, train, evaluate)", "panel")
def feature_missingness(spark, sf):
    """Missing values of each feature in training and evaluation rows, and rows with any ('any')."""
    p = the_panel(spark, sf).where("analytic_eligible AND target_period <= 2000").withColumn("any", F.when(~F.exists(F.array(*panel.LOG_INPUTS), lambda c: c.isNull()), 1.0))
    early, late = F.col("target_period") < 2000, F.col("target_period") == 2000
    one = p.agg(*[F.struct(F.lit(c).alias("feature"), F.count_if(early & F.col(c).isNull()).alias("train"), F.count_if(late & F.col(c).isNull()).alias("evaluate")).alias(c) for c in _COLUMNS])
    return one.select(F.explode(F.array(*_COLUMNS)).alias("f")).select("f.*")


_SIDE = "avg(history_count) FILTER ({w}) AS {n}_mean, stddev_pop(history_count) FILTER ({w}) AS {n}_deviation, min(history_count) FILTER ({w}) AS {n}_least, max(history_count) FILTER ({w}) AS {n}_most, count(*) FILTER ({w}) AS {n}_rows"


@register(
    "SELECT train_rows, evaluate_rows, train_least, evaluate_least, train_most, evaluate_most, round(train_mean, 6) AS train_mean, round(evaluate_mean, 6) AS evaluate_mean, round(train_deviation, 6) AS train_deviation, round(evaluate_deviation, 6) AS evaluate_deviation, round((evaluate_mean - train_mean) / nullif(train_deviation, 0), 6) AS shift, CASE WHEN train_deviation = 0 THEN 'training counts do not vary' END AS reason FROM (SELECT "
    + _SIDE.format(w="target_period < 2000", n="train") + ", " + _SIDE.format(w="target_period = 2000", n="evaluate") + " FROM panel WHERE analytic_eligible AND target_period <= 2000)",
    "panel",
)
def history_count_shift(spark, sf):
    """How far the mean number of earlier reports moves from training to evaluation, in training deviations."""
    p = the_panel(spark, sf).where("analytic_eligible AND target_period <= 2000")
    return six(evaluate.count_shift(p.where("target_period < 2000"), p.where("target_period = 2000"), "history_count"))


@register("SELECT CASE WHEN target_period < 2000 THEN 'train' ELSE 'evaluate' END AS role, history_count, count(*) AS rows FROM panel WHERE analytic_eligible AND target_period <= 2000 GROUP BY ALL", "panel")
def history_count_frequencies(spark, sf):
    p = the_panel(spark, sf).where("analytic_eligible AND target_period <= 2000")
    return p.groupBy(F.when(F.col("target_period") < 2000, "train").otherwise("evaluate").alias("role"), "history_count").agg(F.count("*").alias("rows"))


@register("SELECT entity_key, feature_period, CASE WHEN target_period > 2000 THEN 'excluded: incomplete period' WHEN NOT analytic_eligible THEN 'excluded: missing target' WHEN target_period = 2000 THEN 'evaluation' ELSE 'train' END AS role FROM panel", "panel")
def population_ledger(spark, sf):
    t = F.col("target_period")
    role = F.when(t > 2000, "excluded: incomplete period").when(~F.col("analytic_eligible"), "excluded: missing target").when(t == 2000, "evaluation").otherwise("train")
    return the_panel(spark, sf).select("entity_key", "feature_period", role.alias("role"))
