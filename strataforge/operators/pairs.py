"""Release pairs: what was public at a feature release, joined with a later release's outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import predictors, ranks


def available(publications: DataFrame) -> DataFrame:
    """(origin, release): releases that were public at each origin release: itself, and those that were published by its earliest possible date at the latest."""
    v, p = F.col("published_value"), F.col("published_precision")
    origin = publications.select(F.col("release").alias("origin"), C.earliest_publication(v, p).alias("at"))
    source = publications.select("release", C.latest_publication(v, p).alias("known"))
    return origin.join(F.broadcast(source), (F.col("release") == F.col("origin")) | (F.col("known") <= F.col("at"))).select("origin", "release")


def history_asof(facts: DataFrame, pairs: DataFrame, publications: DataFrame, value: str = "percent") -> DataFrame:
    """For each pair and entity, all outcomes that were public at the feature release: the last one, their mean and number.

    An entity's outcomes are gathered once, in the order of releases (a short list for each entity), and every pair looks up in that list what was public; outcomes
    aren't copied for each pair. pairs and publications are short lists as well; they come as one row.
    """
    public = available(publications).groupBy(F.col("origin").alias("feature_release")).agg(F.collect_set("release").alias("public"))
    listed = pairs.select("feature_release", "target_release").join(public, "feature_release").agg(F.collect_list(F.struct("feature_release", "target_release", "public")).alias("pairs_"))
    known = facts.where(F.col(value).isNotNull()).groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct("release", F.col(value).cast("double").alias("v")))).alias("known_"))
    looked = known.join(F.broadcast(listed)).select("entity_key", "known_", F.explode("pairs_").alias("p_"))
    own = looked.select("p_.feature_release", "p_.target_release", "entity_key", F.filter("known_", lambda x: F.array_contains("p_.public", x["release"])).alias("h_")).where(F.size("h_") > 0)
    last, count = F.element_at("h_", -1), F.size("h_")
    total = F.aggregate("h_", F.lit(0.0), lambda a, x: a + x["v"])
    return own.select(
        "feature_release", "target_release", "entity_key", last["v"].alias("prior"), last["release"].alias("prior_release"), (total / count).alias("history_mean"), count.cast("long").alias("history_count"),
        F.array_join(F.transform("h_", lambda x: x["release"].cast("string")), ",").alias("history_releases"),
    )


ACCESS = ("person_years", "rate_ratio", "wait", "safety_ratio", "safety_log_width", "acceptance_overall", "acceptance_low", "acceptance_medium", "acceptance_high", "acceptance_hard", "acceptance_expected", "acceptance_log_width")


def acceptance_strata(signals: DataFrame, kind: str) -> DataFrame:
    """(code, release): ratios of all strata of the period before the release, for entities of one kind."""
    at = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    own = signals.where(C.key_kind(F.col("entity_key")) == kind).select("*", C.key_code(F.col("entity_key")).alias("code"), (F.col("period") + 1).alias("release"))
    named = {"overall": "overall", "low": "low", "medium": "medium", "high": "high", "hard-to-place": "hard"}
    return own.groupBy("code", "release").agg(*[at(s, "ratio").alias(f"acceptance_{c}") for s, c in named.items()], *[at("overall", m).alias(f"acceptance_{m}") for m in ("expected", "lower", "upper")])


def with_access(rows: DataFrame, access: DataFrame, strata: DataFrame) -> DataFrame:
    """Rates, waits, safety and acceptance of the feature release, where they are reported, with a flag for each that is missing."""
    a = access.withColumnRenamed("release", "feature_release")
    s = strata.withColumnRenamed("release", "feature_release")
    joined = rows.withColumn("code", C.key_code(F.col("entity_key"))).join(a, ["feature_release", "entity_key"], "left").join(s, ["feature_release", "code"], "left").drop("code")
    measured = joined.withColumns({"wait": C.suppressed_number(F.col("wait_text")), "safety_log_width": C.interval_log_width(F.col("safety_lower"), F.col("safety_upper")), "acceptance_log_width": C.interval_log_width(F.col("acceptance_lower"), F.col("acceptance_upper"))})
    return measured.withColumns({f"missing_{c}": F.col(c).isNull() for c in ACCESS})


def build_pairs(facts: DataFrame, pairs: DataFrame, publications: DataFrame, least: int = 10) -> DataFrame:
    """The feature release's entities with history, target outcome and eligibility; missing targets stay.

    Eligibility is the first reason that holds; `reasons` lists all.
    """
    p = F.broadcast(pairs.select("feature_release", "target_release"))
    universe = facts.join(p, F.col("release") == F.col("feature_release")).select("feature_release", "target_release", "entity_key", F.col("n").alias("feature_n"))
    target = facts.select(F.col("release").alias("target_release"), "entity_key", F.col("n").alias("target_n"), F.col("percent").alias("target_percent"), F.lit(True).alias("target_there"))
    joined = universe.join(history_asof(facts.where(F.col("n") >= least), pairs, publications), ["feature_release", "target_release", "entity_key"], "left").join(target, ["target_release", "entity_key"], "left")
    first = facts.groupBy("entity_key").agg(F.min("release").alias("first_release"))
    rules = reasons(least)
    status = F.coalesce(*[F.when(bad, name) for name, bad in rules.items()], F.lit("eligible"))
    return joined.join(first, "entity_key").withColumns({
        "history_count": F.coalesce("history_count", F.lit(0)), "first_observed": F.col("first_release") == F.col("feature_release"), "status": status,
        "reasons": F.array_join(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()])), ","), "target_logit": C.empirical_logit(F.col("target_n"), F.round("target_percent", 1)),
    }).drop("target_there")


def reasons(least: int) -> dict[str, Column]:
    """What speaks against a pair's row: no later report, one without its share or its number of cases, too few cases, nothing known before."""
    n, there = F.col("target_n"), F.col("target_there")
    return {"missing_target": there.isNull(), "missing_value": there & (n.isNull() | F.col("target_percent").isNull()), "small_target": n < least, "missing_prior": F.col("prior").isNull()}


def strict_vintage_folds(pairs: DataFrame) -> DataFrame:
    """Training pairs of each evaluation pair: their truth is public at its feature release and their cohort ended before its target; folds without any stay."""
    t = F.broadcast(pairs.select(F.col("feature_release").alias("train_feature"), F.col("target_release").alias("train_target"), F.col("target_end").alias("train_end")))
    return pairs.join(t, (F.col("train_target") <= F.col("feature_release")) & (F.col("train_end") < F.col("target_start")), "left").select("feature_release", "target_release", "train_feature", "train_target")


def pair_matrix(rows: DataFrame) -> DataFrame:
    """Predictors and the target as a logit of each pair row, with its pair as text in `pair`."""
    pair = F.concat_ws("-", "feature_release", "target_release").alias("pair")
    return predictors.matrix(rows, "entity_key", pair, "feature_release", "target_release", F.col("target_release").alias("target_period"), predictors.percent_logit(F.col("target_percent")).alias("target_log"), "target_percent")


def training_pairs(pairs: DataFrame) -> dict[int, list[str]]:
    """The pairs that train the fold of each evaluation pair's target release (strict vintage); pairs are a short list and are collected."""
    found: dict[int, list[str]] = {}
    for r in strict_vintage_folds(pairs).where(F.col("train_feature").isNotNull()).collect():
        found.setdefault(r.target_release, []).append(f"{r.train_feature}-{r.train_target}")
    return found


def pooled_reference(facts: DataFrame) -> DataFrame:
    return facts.groupBy("release").agg(F.sum("successes").alias("successes"), F.sum("n").alias("n"), (F.sum("successes") / F.sum("n")).alias("pooled"))


def outcome_summary(predictions: DataFrame, *by: str) -> DataFrame:
    """Release-balanced, pooled, volume-weighted and median errors, and calibration with equal weight for each release.

    Where predictions don't vary, slope and intercept are null and calibration_reason says so.
    """
    x, y, ae = F.col("predicted"), F.col("target_percent"), F.abs(F.col("predicted") - F.col("target_percent"))
    mean = {"ae": ae, "x": x, "y": y, "xx": x * x, "xy": x * y}
    releases = predictions.groupBy(*by, "model", "target_release").agg(
        F.count("*").alias("n"), F.sum(ae).alias("total"), F.sum(x - y).alias("signed"), F.sum(F.col("target_n") * ae).alias("weighted"), F.sum("target_n").alias("volume"), F.min(x).alias("least"), F.max(x).alias("most"), *[F.avg(v).alias(k) for k, v in mean.items()]
    )  # every release has one weight in what follows
    keys = [*by, "model"]
    found = releases.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count("*").alias("releases"), F.avg("ae").alias("balanced_mae"), (F.sum("total") / F.sum("n")).alias("mae"), (F.sum("weighted") / F.sum("volume")).alias("weighted_mae"), (F.sum("signed") / F.sum("n")).alias("signed"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.avg("xx") - F.avg("x") * F.avg("x")).alias("vx"), (F.avg("xy") - F.avg("x") * F.avg("y")).alias("cxy"), (F.min("least") == F.max("most")).alias("flat"),
    )
    medians = ranks.percentiles(predictions.withColumn("ae", ae), keys, "ae", [0.5]).select(*keys, F.col("p")[0].alias("median_ae"))
    flat = F.col("flat") | (F.col("vx") <= 1e-9)
    slope = F.when(~flat, F.try_divide(F.col("cxy"), F.col("vx")))
    return found.join(medians, keys, "left").select(*keys, "rows", "releases", "balanced_mae", "mae", "weighted_mae", "median_ae", "signed", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(flat, "predictions do not vary").alias("calibration_reason"))


def cuts(rows: DataFrame) -> DataFrame:
    """One row per evaluation cut that a prediction belongs to."""
    every = F.lit("all")
    members = {
        "primary": (every, F.lit(True)), "release": (F.col("target_release").cast("string"), F.lit(True)), "quartile": (F.col("quartile").cast("string"), F.lit(True)),
        "n>=20": (every, F.col("target_n") >= 20), "n>=30": (every, F.col("target_n") >= 30), "first": (F.col("first_observed").cast("string"), F.lit(True)), "features": (F.when(F.col("any_missing"), "missing").otherwise("complete"), F.lit(True)),
    }
    cells = [F.struct(F.lit(name).alias("cut"), value.alias("cut_value"), inside.alias("in")) for name, (value, inside) in members.items()]
    return rows.withColumn("c_", F.explode(F.filter(F.array(*cells), lambda c: c["in"]))).select(*rows.columns, "c_.cut", "c_.cut_value")


def pair_counts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per pair: the universe, targets matched, missing and only in the target release, eligible rows at three sizes, rows by status, and the number of different timings."""
    good = F.col("status") == "eligible"
    own = rows.groupBy("feature_release", "target_release").agg(
        F.count("*").alias("universe"), F.count("target_n").alias("matched"), F.count_if(F.col("target_n").isNull()).alias("missing"), *[F.count_if(good & (F.col("target_n") >= n)).alias(f"eligible{n}") for n in (10, 20, 30)], F.count_if("first_observed").alias("first_seen"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("missing_target", "small_target", "missing_prior")], F.countDistinct("feature_start", "feature_end", "target_start", "target_end").alias("timings"),
    )
    keys = rows.select("feature_release", "target_release", "entity_key")
    there = targets.select(F.col("release").alias("target_release"), "entity_key").join(F.broadcast(keys.select("feature_release", "target_release").distinct()), "target_release")
    only = there.join(keys, ["feature_release", "target_release", "entity_key"], "left_anti").groupBy("feature_release", "target_release").agg(F.count("*").alias("target_only"))
    table = there.groupBy("feature_release", "target_release").agg(F.count("*").alias("target_rows"))
    return own.join(table, ["feature_release", "target_release"], "left").join(only, ["feature_release", "target_release"], "left").withColumn("target_only", F.coalesce("target_only", F.lit(0)))


def leakage(pairs: DataFrame, publications: DataFrame, most_offset: int = 0) -> DataFrame:
    """(feature_release, target_release, rule) of the pairs (with windows and ends of follow-up) that break a rule of time."""
    v, p = F.col("published_value"), F.col("published_precision")
    dated = publications.select("release", C.earliest_publication(v, p).alias("earliest"), C.latest_publication(v, p).alias("latest"))
    f = dated.select(F.col("release").alias("feature_release"), F.col("earliest").alias("origin"))
    t = dated.select(F.col("release").alias("target_release"), F.col("latest").alias("known"))
    rows = pairs.join(F.broadcast(f), "feature_release", "left").join(F.broadcast(t), "target_release", "left")
    offset, start = C.month_offset(F.col("target_start"), F.col("origin")), F.col("target_start")
    rules = {
        "unknown release": F.col("origin").isNull() | F.col("known").isNull(), "target release does not follow": F.col("target_release") <= F.col("feature_release"), "origin outside the allowed months": ~offset.between(0, most_offset),
        "target is public at the origin": F.col("known") <= F.col("origin"), "predictors reach into the target": F.col("feature_end") >= start, "follow-up reaches into the target": F.col("follow_up_end") >= start,
    }
    broken = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(bad, F.lit(False)).alias("bad")) for k, bad in rules.items()]), lambda x: x["bad"])
    own = rows.select("feature_release", "target_release", F.explode(F.transform(broken, lambda x: x["rule"])).alias("rule"))
    other = F.broadcast(pairs.select(F.col("feature_release").alias("o_feature"), F.col("target_release").alias("o_target"), F.col("target_start").alias("o_start"), F.col("target_end").alias("o_end")))
    different = (F.col("o_feature") != F.col("feature_release")) | (F.col("o_target") != F.col("target_release"))
    overlap = pairs.join(other, different & (F.col("target_start") <= F.col("o_end")) & (F.col("o_start") <= F.col("target_end"))).select("feature_release", "target_release", F.lit("target cohorts overlap").alias("rule")).distinct()
    return own.unionByName(overlap)
