"""Operators on hand-made rows: boundaries, ties, gaps, leakage, constants, and models against closed forms."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataforge.functions import columns as C
from strataforge.operators import accounting, checks, evaluate, folds, gates, intervals, models, pairs, panel, ranks, resample


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,value", [("1,234", 1234.0), (" 5 ", 5.0), ("-", None), ("n/a", None), ("", None), (".", None), ("null", None), ("abc", None), ("inf", None)])
def test_clean_number(spark, raw, value):
    assert one(spark, C.clean_number(F.col("c")), c=("string", raw)) == value


def test_bad_numbers_are_told_from_missing_ones(spark):
    assert one(spark, C.bad_number(F.col("c")), c=("string", "abc")) and not one(spark, C.bad_number(F.col("c")), c=("string", "N/A"))


def test_counts_and_percentages(spark):
    assert one(spark, C.clean_count(F.col("c")), c=("string", "1,000")) == 1000
    assert one(spark, C.clean_count(F.col("c")), c=("string", "1.5")) is None
    assert one(spark, C.clean_percent(F.col("c")), c=("double", 100 + 5e-11)) == 100.0
    assert one(spark, C.clean_percent(F.col("c")), c=("double", 100.1)) is None


def test_dates(spark):
    v, p = F.col("v"), F.col("p")
    assert one(spark, C.latest_publication(v, p), v=("string", "2024-06"), p=("string", "month")) == dt.date(2024, 6, 30)
    assert one(spark, C.earliest_publication(v, p), v=("string", "2024-07"), p=("string", "month")) == dt.date(2024, 7, 1)
    assert one(spark, C.elapsed_fraction(v, p, F.lit(2024)), v=("string", "2024-12-31"), p=("string", "day")) == 1.0
    assert one(spark, C.elapsed_fraction(v, p, F.lit(2024)), v=("string", "2024-07"), p=("string", "month")) == 0.5
    for raw in ("2024-12-30", "1/2/2025", str((dt.date(2024, 12, 31) - dt.date(1899, 12, 30)).days)):
        assert one(spark, C.normalize_date(F.col("c"), F.lit("2024-12-31").cast("date")), c=("string", raw)) == dt.date(2024, 12, 31)
    assert one(spark, C.normalize_date(F.col("c"), F.lit("2024-12-31").cast("date")), c=("string", "2025-01-03")) is None


@pytest.mark.parametrize("n,percent", [(1, 0.0), (1, 100.0), (10, 50.0)])
def test_logits_at_the_ends(spark, n, percent):
    s = math.floor(n * percent / 100 + 0.5)
    p = (s + 0.5) / (n + 1)
    assert one(spark, C.empirical_logit(F.col("n"), F.col("p")), n=("long", n), p=("double", percent)) == pytest.approx(math.log(p / (1 - p)))
    assert one(spark, C.empirical_logit(F.col("n"), F.col("p")), n=("long", 3), p=("double", 50.0)) is None


def test_quartiles_of_six_and_of_ties(spark):
    rows = [("e%d" % i, 1.0, 2000) for i in range(6)]
    for data in (rows, rows[::-1]):
        found = spark.createDataFrame(data, "entity_key string, v double, t int").transform(lambda d: panel.with_quartile(d, "v", "t")).withColumnRenamed("quartile", "q").orderBy("entity_key").collect()
        assert [r.q for r in found] == [1, 1, 2, 3, 3, 4]


def signals(spark, rows):
    return spark.createDataFrame([(e, p, s, 100, 10, 12.5, r, r * 0.8 if r else None, r * 1.2 if r else None) for e, p, r in rows for s in ("overall", "low", "medium", "high", "hard-to-place")], "entity_key string, period int, stratum string, n long, observed long, expected double, ratio double, lower double, upper double")


def releases(spark):
    return spark.createDataFrame([(p, p, f"{p + 1}-07", "month") for p in range(2000, 2010)], "period int, release int, published_value string, published_precision string")


def test_a_gap_is_not_adjacent_and_targets_don_t_leak(spark):
    rows = [("a", 2000, 1.0), ("a", 2001, 1.1), ("a", 2003, 1.3), ("b", 2001, 0.9)]
    found = {(r.entity_key, r.feature_period): r for r in panel.build_panel(signals(spark, rows), releases(spark)).collect()}
    assert found["a", 2001].previous_log == 0.0 and found["a", 2001].target_ratio is None
    assert found["a", 2003].previous_log is None and not found["a", 2003].analytic_eligible and found["a", 2003].public_forecast_eligible
    assert found["b", 2001].first_observed and not found["b", 2001].public_forecast_eligible
    changed = {(r.entity_key, r.feature_period): r for r in panel.build_panel(signals(spark, [*rows[:2], ("a", 2003, 9.0), rows[3]]), releases(spark)).collect()}
    assert changed["a", 2001] == found["a", 2001]


def test_balanced_is_not_pooled(spark):
    rows = [(1, "m", 1.0)] * 9 + [(2, "m", 3.0)]
    r = evaluate.balanced_mean(spark.createDataFrame(rows, "target_period int, model string, absolute_log double")).first()
    assert r.balanced == 2.0 and r.pooled == pytest.approx(1.2)


@pytest.mark.parametrize("n,rank", [(29, None), (30, 25), (229, 184)])
def test_order_statistics(spark, n, rank):
    df = spark.createDataFrame([(1, "m", float(i)) for i in range(1, n + 1)], "target_period int, model string, absolute_log double")
    assert evaluate.band_radius(df, "target_period", "model").first().radius == (None if rank is None else float(rank))


def test_constants_have_no_slope_or_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0)], "g int, x double, y double")
    r = evaluate.association(df, "x", "y", "g").first()
    assert r.correlation is None and r.reason == "constant"
    assert evaluate.association(df.limit(2), "x", "y", "g").first().reason == "fewer than 3 pairs"


def test_bootstraps_with_missing_periods(spark):
    """Entity a has period 1 only and b period 2 only: replicates that draw one of them twice miss a period."""
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 3.0)], "entity_key string, target_period int, difference double")
    skip, drop, redraw = (f(df, 100, 3).first() for f in (resample.clustered_skip, resample.clustered_drop, resample.clustered_redraw))
    assert 0 < skip.skipped < 100 and skip.retained + skip.skipped == 100 and skip.lower == skip.upper == 2.0
    assert drop.retained == 100 and drop.lower == 1.0 and drop.upper == 3.0
    assert redraw.retained > skip.retained and redraw.attempts > redraw.retained
    shuffled = df.orderBy(F.desc("entity_key"))
    assert resample.clustered_drop(shuffled, 100, 3).first() == drop


def accounts_frame(spark, rows):
    return accounting.with_accounts(spark.createDataFrame([(e, y, s, x, a, *([r] + [0] * 7)) for e, y, s, x, a, r in rows], "entity_key string, year int, start long, end long, additions long, " + ", ".join(f"{r} long" for r in accounting.REMOVALS)))


def test_reasons_in_order(spark):
    rows = [("ok", 1, 10, 12, 5, 3), ("ok", 2, 12, 13, 4, 3), ("gap", 1, 1, 2, 1, 0), ("gap", 3, 1, 2, 1, 0), ("miss", 1, 1, 1, 0, None), ("miss", 2, 1, 1, 0, 0), ("res", 1, 1, 5, 1, 0), ("res", 2, 9, 9, 0, 0), ("bound", 1, 1, 2, 1, 0), ("bound", 2, 3, 3, 0, 0), ("zero", 1, 0, 1, 1, 0), ("zero", 2, 1, 1, 0, 0)]
    found = {r.entity_key: r for r in accounting.compared(accounts_frame(spark, rows)).collect()}
    assert {k: r.reason for k, r in found.items()} == {"ok": None, "miss": "missing", "res": "residual", "bound": "boundary", "zero": "zero"}
    assert found["ok"].growth_change == -1 and found["ok"].contrib_r0 == 0


def test_longest_run_and_common_entities(spark):
    df = spark.createDataFrame([("a", y) for y in (1, 2, 4, 5, 7)] + [("b", y) for y in (1, 2, 4, 5, 7, 8, 9)] + [("c", 1)], "entity_key string, year int")
    found = {r.entity_key: (r.first_year, r.last_year, r.years) for r in accounting.longest_run(df).collect()}
    assert found == {"a": (4, 5, 2), "b": (7, 9, 3), "c": (1, 1, 1)}
    assert [r.entity_key for r in accounting.in_all_years(df).collect()] == ["b"]


def test_violations_are_rows(spark):
    df = spark.createDataFrame([("a", 1, "overall", 0, 1, 0.0, None, None, None), ("b", 1, "low", 5, 6, 1.0, 2.0, 1.0, 1.5)], "entity_key string, period int, stratum string, n long, observed long, expected double, ratio double, lower double, upper double")
    found = checks.violations(df, checks.measure_rules())
    assert {(r.rule, r.entity_key) for r in found.collect()} == {("zero n with counts", "a"), ("observed above n", "a"), ("incomplete overall", "a"), ("observed above n", "b"), ("ratio outside interval", "b")}
    with pytest.raises(ValueError, match="observed above n"):
        checks.require_clean(found.where("rule = 'observed above n'"))


def test_history_and_reasons(spark):
    facts = spark.createDataFrame([(1997, "a", 20, 50.0, 10), (1998, "a", 5, 40.0, 2), (1999, "a", 20, 60.0, 12), (1997, "b", 20, 10.0, 2), (1999, "b", 5, 20.0, 1)], "release int, entity_key string, n long, percent double, successes long")
    wanted = spark.createDataFrame([(1997, 1999)], "feature_release int, target_release int")
    dates = spark.createDataFrame([(1997, "1997-07", "month"), (1998, "1998-07-07", "day"), (1999, "1999-07-07", "day")], "release int, published_value string, published_precision string")
    found = {r.entity_key: r for r in pairs.build_pairs(facts, wanted, dates).collect()}
    assert found["a"].status == "eligible" and found["a"].prior == 50.0 and found["a"].history_count == 1
    assert found["b"].status == "small_target" and found["b"].reasons == "small_target"


def test_ridge_equals_the_closed_form(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 3))
    y = x @ [1.0, -0.5, 0.0] + 0.1 * r.normal(size=120)
    rows = [(1, float(b), *(None if c == 1 and k % 7 == 0 else float(v) for c, v in enumerate(a)), 4.0, None) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "eval_period int, y double, f0 double, f1 double, f2 double, same double, gone double")
    names = ["f0", "f1", "f2", "same", "gone"]
    (fit,) = models.fit_folds(df, names, "y")
    filled = x.copy()
    holes = np.arange(120) % 7 == 0
    filled[holes, 1] = np.median(x[~holes, 1])
    z = (filled - filled.mean(0)) / filled.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert fit.coefficients(10.0)[:3] == pytest.approx(w) and fit.coefficients(10.0)[3:] == pytest.approx([0, 0])
    fitted = models.parameters(spark, [fit], names, [10.0])
    got = models.predictions(df.withColumn("id", F.monotonically_increasing_id()), fitted, names).orderBy("id").toPandas().predicted_log
    assert got.to_numpy() == pytest.approx(z @ w + y.mean())


def test_clopper_pearson(spark):
    df = spark.createDataFrame([(187, 229), (0, 10), (10, 10)], "k long, n long")
    found = {r.k: (r.lower, r.upper) for r in intervals.clopper_pearson(df, "k", "n").collect()}
    assert found[187] == pytest.approx((0.7603, 0.8645), abs=1e-4)
    assert found[0][0] == 0.0 and found[10][1] == 1.0 and found[0][1] == pytest.approx(1 - found[10][0])


def test_the_filter_reaches_the_scan(spark, sf, tmp_path):
    from strataforge.plans.panel_queries import the_panel
    from strataforge.sources import storage

    path = str(tmp_path / "panel")
    storage.write_table(the_panel(spark, sf), path, order=["entity_key"], partition="target_period")
    df = storage.scan_panel(spark, path, the_panel(spark, sf).schema, 1999)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target_period" in plan and df.agg(F.max("target_period")).first()[0] == 1999
    with pytest.raises(ValueError, match="schema"):
        storage.scan_panel(spark, path, df.select("entity_key").schema, 1999)


def test_streamed_vintages(spark, tmp_path):
    from strataforge.streaming import vintages

    schema = "entity_key string, year int, release int, value long, published timestamp"
    day = lambda n: dt.datetime(2020, 1, n)
    spark.createDataFrame([("a", 1, 1, 5, day(1)), ("a", 1, 2, 6, day(2)), ("b", 1, 1, 7, day(1)), ("a", 1, 1, 5, day(1))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = vintages.first_vintages(stream, "10 days").writeStream.format("memory").queryName("first_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.entity_key, r.release) for r in spark.sql("select * from first_rows").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_redraw_goes_on_until_complete(spark):
    """Three entities in periods of their own: about 22 % of the draws are complete."""
    rows = [(k, 2000 + k, float(k)) for k in range(3)]
    got = resample.clustered_redraw(spark.createDataFrame(rows, "entity_key long, target_period int, difference double")).collect()[0]
    assert got.retained == 200 and 400 < got.attempts < 2000 and got.lower == got.upper == 1.0
    rows = [(k, 2000 + k, float(k)) for k in range(12)]
    got = resample.clustered_redraw(spark.createDataFrame(rows, "entity_key long, target_period int, difference double"), 20, most=3).first()
    assert got.retained < 20 and got.lower is got.median is got.upper is None


@pytest.mark.parametrize("most", [10_000, 60])
def test_draws_by_ranges(spark, most):
    """Sums over the drawn entities, in one range and in several: as many draws as entities in each replicate, and the same again in another order."""
    r = np.random.default_rng(4)
    rows = [(f"k{k:04d}", p, float(r.normal()), 1) for k in range(500) for p in (1, 2)]
    cells = spark.createDataFrame(rows, "entity_key string, target_period int, total double, rows long")
    get = lambda df: {(x.replicate, x.target_period): (x.total, x.n) for x in resample.drawn_sums(df, 300, 11, 5, most).groupBy("replicate", "target_period").agg(F.sum("total").alias("total"), F.sum("rows").alias("n")).collect()}
    found = get(cells)
    assert {k[0] for k in found} == set(range(5, 305)) and {n for _, n in found.values()} == {500.0}
    means = np.array([found[k, 1][0] for k in range(5, 305)]) / 500
    values = np.array([x[2] for x in rows if x[1] == 1])
    assert abs(means.mean() - values.mean()) < 4 * values.std() / math.sqrt(500 * 300) and means.std() == pytest.approx(values.std() / math.sqrt(500), rel=0.15)
    if most > 500:
        assert found.keys() == get(cells.orderBy(F.rand(3))).keys()
        times = np.bincount(resample.draw(11, 5, 0, np.arange(500), 500), minlength=500)
        assert found[5, 1][0] == pytest.approx(times @ values)


def test_draws_are_even():
    counts = np.bincount(resample.draw(1, 2, 3, np.arange(200_000), 100), minlength=100)
    assert ((counts - 2000) ** 2 / 2000).sum() < 180  # chi-squared with 99 degrees of freedom
    assert resample.draw(1, 2, 3, np.arange(3), 10**12).max() > 2**32


def test_intervals_of_any_size():
    """Against the binomial tail itself, and closed forms for 10^9 rows."""
    def tail(k, n, p):
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    for n in (1, 2, 30, 400, 5000):
        for k in sorted({0, 1, n // 3, n - 1, n}):
            (low,), (high,) = intervals.binomial_bounds(np.array([k]), np.array([n]), 0.95)
            assert low == 0 if k == 0 else tail(k, n, low) == pytest.approx(0.025, rel=1e-8)
            assert high == 1 if k == n else 1 - tail(k + 1, n, high) == pytest.approx(0.025, rel=1e-6)
    n = 10**9
    low, high = intervals.binomial_bounds(np.array([0, n, n // 2, 0]), np.array([n, n, n, 0]), 0.95)
    assert high[0] == pytest.approx(-math.expm1(math.log(0.025) / n), rel=1e-9) and 1 - low[1] == pytest.approx(high[0], rel=1e-6)
    assert (high[2] - low[2]) / 2 == pytest.approx(1.959964 * math.sqrt(0.25 / n), rel=1e-4) and np.isnan(low[3])


def test_folds_of_cells_equal_their_rows(spark):
    """Medians, moments and deviations of overlapping folds, with missing values, ties, a constant and a large offset."""
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 4)) * [1, 1e-3, 5, 1] + [0, 1e6, 0, 0]
    x[:, 2] = np.round(x[:, 2])
    x[:, 3] = 7.25
    gone = r.random(x.shape) < [0.3, 0.1, 0.0, 0.5]
    cell, y = r.integers(0, 6, 400), r.normal(size=400)
    rows = spark.createDataFrame([(int(c), float(t), *(None if g else float(v) for v, g in zip(a, b, strict=True))) for c, t, a, b in zip(cell, y, x, gone, strict=True)], "cell int, y double, a double, b double, c double, d double")
    trained = {k: [str(c) for c in range(k)] for k in (1, 3, 6)} | {9: ["2", "5"], 10: []}
    fits, _ = models.fit_cells(rows, ["a", "b", "c", "d"], "y", F.col("cell"), lambda cells: trained)
    assert [f.fold for f in fits] == [1, 3, 6, 9]
    for fit in fits:
        own = np.isin(cell.astype(str), trained[fit.fold])
        data = np.where(gone[own], np.nan, x[own])
        middle = np.nanmedian(data, axis=0)
        filled = np.where(np.isnan(data), middle, data)
        assert fit.rows == own.sum() and fit.medians.tolist() == middle.tolist() and fit.mean_y == pytest.approx(y[own].mean())
        assert fit.means == pytest.approx(filled.mean(0)) and fit.cross == pytest.approx(np.cov(filled.T, bias=True), abs=1e-9)
        assert fit.scales[:3] == pytest.approx(filled.std(0)[:3], rel=1e-6) and fit.scales[3] == 1
        assert fit.cross_y == pytest.approx(((filled - filled.mean(0)) * (y[own] - y[own].mean())[:, None]).mean(0), abs=1e-9)


def test_drift_of_a_few_files(spark, tmp_path):
    """A table in which one file lacks a column and another has one more is refused, and each file is named."""
    from strataforge.sources import contracts, storage

    path = f"{tmp_path}/table with blanks"
    whole = spark.range(50).selectExpr("id AS k", "id * 0.5D AS v", "CAST(id % 3 AS INT) AS p")
    storage.write_table(whole, path, ["k"], "p")
    assert storage.read_exact(spark, path, whole.schema).count() == 50 and contracts.schema_violations(spark, path, whole.schema).count() == 0
    spark.range(5).selectExpr("id AS k").write.parquet(f"{path}/p=7")
    spark.range(5).selectExpr("id AS k", "1.0D AS v", "'x' AS more").write.parquet(f"{path}/p=8")
    found = {(r.file.split("/")[-2], r.column, r.rule) for r in contracts.schema_violations(spark, path, whole.schema).collect()}
    assert found == {("p=7", "v", "missing column"), ("p=8", "more", "column not declared")}
    with pytest.raises(ValueError, match="missing column"):
        storage.read_exact(spark, path, whole.schema)


def test_large_values_are_written_by_several_tasks(spark, tmp_path):
    from strataforge.sources import storage

    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr("id AS k", "CAST(IF(id % 10 = 0, id % 3, 9) AS INT) AS p", "md5(CAST(id AS STRING)) AS v")
        storage.write_table(rows, f"{tmp_path}/t", ["k"], "p")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = spark.read.parquet(f"{tmp_path}/t").select("p", F.col("_metadata.file_name").alias("f"), "k").groupBy("p").agg(F.countDistinct("f").alias("files"), F.count("*").alias("rows"))
    found = {r.p: (r.files, r.rows) for r in files.collect()}
    assert found[9][0] > 3 and found[9][1] == 54_000 and all(found[p][1] == 2000 for p in (0, 1, 2))


def test_sweep_and_overlaps_equal_plain_ones(spark):
    """Two groups, one with most intervals, over several sorted ranges; ties, single days and intervals that contain others."""
    from strataforge.operators import windows

    r = np.random.default_rng(6)
    rows = []
    for k in range(400):
        start = dt.date(2020, 1, 1) + dt.timedelta(int(r.integers(0, 1500)))
        rows.append(("a" if k % 10 else "b", start, start + dt.timedelta(int(r.choice([0, 1, 5, 400]))), k))
    df = spark.createDataFrame(rows, "g string, s date, e date, k int").repartition(5)
    got = {x.k: x.reach for x in windows.sweep(df, "g", "s", "e", "k").collect()}
    for g, s, e, k in rows:
        before = [x[2] for x in rows if x[0] == g and (x[1], x[2], x[3]) < (s, e, k)]
        assert got[k] == max(before, default=None)
    a, b = (df.select("g", F.col("s").alias(f"start_{x}"), F.col("e").alias(f"end_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    pairs_ = sorted((x.k_a, x.k_b) for x in windows.overlaps(a, b, 30, ("g",)).collect())
    assert pairs_ == sorted((x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


def test_predictors_are_declared_ones(spark):
    from strataforge.operators import predictors

    df = spark.createDataFrame([(50.0, 0.0), (None, -1.0)], "prior double, wait double")
    got = predictors.matrix(df, names=["log_wait", "prior_logit", "missing_waiting"]).collect()
    assert [tuple(x) for x in got] == [(0.0, 0.0, 0.0), (None, None, 0.0)]
    for names in (["entity_key"], ["log_wait", "log_wait"], []):
        with pytest.raises(ValueError, match="declared"):
            predictors.matrix(df, names=names)
    with pytest.raises(ValueError, match="lacks the columns"):
        predictors.matrix(df)


def test_equal_errors_are_no_improvement_in_any_order(spark):
    """0.3 + 0.2 + 0.1 is less than 0.1 + 0.2 + 0.3 in doubles."""
    rows = [(m, 1996, e, 0.0) for m, es in (("persistence", (0.1, 0.2, 0.3)), ("historical_mean", (0.3, 0.2, 0.1))) for e in es]
    found = gates.continuation(spark.createDataFrame(rows, "model string, feature_release int, predicted double, target_percent double").coalesce(1), "historical_mean", ("persistence",))
    assert [r.passed for r in found.where("criterion = 'improvement'").collect()] == [False]


def test_lines_are_joined_with_orders_in_bounded_tasks(spark, monkeypatch):
    from strataforge.sources import tables

    monkeypatch.setattr(tables, "LINES", 100)
    lines = spark.range(2_000).select((F.col("id") % 700).alias("l_orderkey"), "id")
    orders = spark.range(500).select(F.col("id").alias("o_orderkey"))
    joined = tables.with_orders(lines, orders)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 300
    assert sorted(r.id for r in joined.select("id").collect()) == [k for k in range(2_000) if k % 700 < 500]


def test_logarithms_keep_their_last_bit(spark):
    """Errors at the edge of a band: the panel's logarithm is the C library's, and errors are differences of the logarithms themselves."""
    ratios = [k / 10_000 for k in range(5_000, 20_000, 7)]
    df = spark.createDataFrame([(r, q) for r, q in zip(ratios, reversed(ratios))] + [(0.0, 1.0), (None, 1.0)], "target_ratio double, q double")
    logs = df.withColumns({"target_log": C.comparable_log(F.col("target_ratio")), "predicted_log": C.comparable_log(F.col("q"))})
    got = panel.with_errors(logs.withColumn("predicted_ratio", F.exp("predicted_log"))).collect()
    assert [r.target_log for r in got] == [math.log(r) for r in ratios] + [None, None]
    assert [r.signed_log for r in got] == [math.log(q) - math.log(r) for r, q in zip(ratios, reversed(ratios))] + [None, None]


def test_ranks_are_exact_when_sketches_differ(spark):
    """Rows come in another order each time they are read, as from several executors, and so do the sketches that bracket the ranks: a task's 300,000 rows are more than these hold exactly."""

    def shuffled(batches):
        yield pd.concat(list(batches)).sample(frac=1.0)

    n, parts = 600_000, [k / 20 for k in range(1, 20)]
    df = spark.range(0, n, 1, 2).selectExpr("0 AS g", "cast(id as double) AS v").persist().mapInPandas(shuffled, "g int, v double")
    got = ranks.order_values(df, ["g"], "v", parts, lambda n: [F.ceil(n * k / F.lit(20)) for k in range(1, 20)]).first()
    assert got.n == n and list(got["values"]) == [n * k / 20 - 1 for k in range(1, 20)]
