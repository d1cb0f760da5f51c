"""Contract checks: violations are rows (rule, entity_key, period, detail), never exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], period: str = "period", detail: Column | None = None) -> DataFrame:
    """One row for each rule that a row breaks; one pass over `df`. A rule that is null counts as kept."""
    broken = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("bad")) for k, v in rules.items()]), lambda x: x["bad"])
    text = (detail if detail is not None else F.lit(None)).cast("string")
    return df.select(F.explode(broken).alias("v_"), "entity_key", F.col(period).alias("period"), text.alias("detail")).select("v_.rule", "entity_key", "period", "detail")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(facts: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Fact keys that the directory lacks."""
    return facts.select(*keys).distinct().join(known.select(*keys).distinct(), list(keys), "left_anti")


def require_clean(found: DataFrame) -> None:
    """Fails with the first few violations, if there are any."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(f"{r.rule}: {r.entity_key} {r.period} {r.detail or ''}".strip() for r in rows))


def measure_rules() -> dict[str, Column]:
    n, o, e, r, lo, up = (F.col(c) for c in ("n", "observed", "expected", "ratio", "lower", "upper"))
    return {
        "zero n with counts": (n == 0) & ((o != 0) | (e != 0)),
        "observed above n": o > n,
        "expected above n": e > n,
        "half-reported interval": lo.isNull() != up.isNull(),
        "ratio outside interval": (r < lo) | (r > up),
        "incomplete overall": (F.col("stratum") == "overall") & (r.isNull() | lo.isNull() | up.isNull()),
    }


def period_rules() -> dict[str, Column]:
    """For rows with feature_period, target_period, opens and closes."""
    year = F.col("feature_period")
    whole = (F.col("opens") == F.make_date(year, F.lit(1), F.lit(1))) & (F.col("closes") == F.make_date(year, F.lit(12), F.lit(31)))
    return {"target is not the next period": F.col("target_period") != year + 1, "not a full calendar year": ~whole}


def release_contract(found: DataFrame, declared: DataFrame, key: str, least_columns: int) -> DataFrame:
    """Releases whose rows or columns (found: key, rows, columns) differ from the declared ones, or that lack required columns."""
    both = found.join(F.broadcast(declared), key)
    rules = {"row count": F.col("rows") != F.col("declared_rows"), "column count": F.col("columns") != F.col("declared_columns"), "required column": F.col("columns") < least_columns}
    broken = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("bad")) for k, v in rules.items()]), lambda x: x["bad"])
    return both.select(key, "rows", "declared_rows", "columns", "declared_columns", F.explode(F.transform(broken, lambda x: x["rule"])).alias("rule"))


def metadata_violations(panel: DataFrame, releases: DataFrame) -> DataFrame:
    """Rows of the panel whose attributes differ from those of their release, or of the target's."""
    own = releases.select(F.col("period").alias("feature_period"), F.col("published_value").alias("r_value"), F.col("published_precision").alias("r_precision"))
    truth = releases.select((F.col("period") - 1).alias("feature_period"), F.col("published_value").alias("t_value"))
    p = panel.join(F.broadcast(own), "feature_period", "left").join(F.broadcast(truth), "feature_period", "left")
    end = F.make_date(F.col("target_period"), F.lit(12), F.lit(31))
    fields = {"published value": ("published_value", F.col("r_value")), "precision": ("published_precision", F.col("r_precision")), "target end": ("target_end", end), "truth value": ("truth_published_value", F.col("t_value"))}
    cells = [F.struct(F.lit(rule).alias("rule"), ~F.col(c).eqNullSafe(known) & known.isNotNull() if c == "truth_published_value" else ~F.col(c).eqNullSafe(known), F.col(c).cast("string").alias("detail")) for rule, (c, known) in fields.items()]
    broken = F.filter(F.array(*cells), lambda x: x["col2"])
    return p.select(F.explode(broken).alias("v_"), "entity_key", F.col("feature_period").alias("period")).select("v_.rule", "entity_key", "period", "v_.detail")


def panel_rules() -> dict[str, Column]:
    """For panel rows with ratio, lower, upper, and what is stored beside what follows: stored_width, counted, earlier."""
    mean, count = F.col("history_mean"), F.col("counted")
    return {
        "stored width differs": F.abs(F.col("stored_width") - F.col("log_width")) > 1e-12,
        "flag differs from its value": F.col("missing_log_low") != F.col("log_low").isNull(),
        "empty history with a mean": (count == 0) & mean.isNotNull(),
        "history without a mean": (count > 0) & mean.isNull(),
        "single value differs from the mean": (F.col("history_count") == 1) & (F.abs(mean - F.col("current_log")) > 1e-12),
        "first observed with history": F.col("first_observed") & (F.col("earlier") > 1),
        "interval does not contain the ratio": (F.col("ratio") < F.col("lower")) | (F.col("ratio") > F.col("upper")),
        "negative measure": (F.col("n") < 0) | (F.col("expected") < 0),
    }


def pair_rules(measures: tuple[str, ...]) -> dict[str, Column]:
    """For rows of release pairs: measures with their missing_ flags, bounds of safety and acceptance, and what is known of earlier outcomes."""
    c = F.col
    any_of = lambda rules: F.exists(F.array(*[F.coalesce(r, F.lit(False)) for r in rules]), lambda x: x)
    infinite = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    safety, acceptance = [c(f"safety_{x}") for x in ("ratio", "lower", "upper")], [c(f"acceptance_{x}") for x in ("overall", "lower", "upper")]
    outside = lambda v: (v[0] < v[1]) | (v[0] > v[2])
    width, count, mean, prior = c("safety_log_width"), c("history_count"), c("history_mean"), c("prior")
    parts = F.array_size(F.filter(F.array(*safety), lambda x: x.isNull()))
    return {
        "flag differs from its measure": any_of([c(f"missing_{m}") != c(m).isNull() for m in measures]),
        "measure is not finite": any_of([infinite(c(m)) for m in measures]),
        "measure below zero": any_of([c(m) < 0 for m in measures]),
        "share outside 0 to 100": any_of([(v < 0) | (v > 100) for v in (prior, mean)]),
        "one bound without the other": acceptance[1].isNull() != acceptance[2].isNull(),
        "bounds in the wrong order": (acceptance[1] > acceptance[2]) | (safety[1] > safety[2]),
        "ratio outside its bounds": any_of([outside(acceptance), outside(safety)]),
        "safety reported in part": (parts > 0) & (parts < 3),
        "safety width differs from its bounds": F.when(parts > 0, width.isNotNull()).otherwise(width.isNull() | (F.abs(width - (F.log(safety[2]) - F.log(safety[1]))) > 1e-12)),
        "history and its count disagree": F.when(count == 0, prior.isNotNull() | mean.isNotNull()).otherwise(prior.isNull() | mean.isNull()),
        "only outcome differs from its mean": (count == 1) & (F.abs(mean - prior) > 1e-12),
        "first seen with earlier outcomes": c("first_observed") & ((count > 1) | (c("prior_release") != c("feature_release"))),
    }


def attribute_violations(rows: DataFrame, declared: DataFrame, keys: list[str], fields: list[str], *kept: str) -> DataFrame:
    """(kept, keys, rule, detail): fields of `rows` that aren't those declared for their keys, a short list that is broadcast; rows whose keys aren't declared."""
    known = declared.select(*keys, F.lit(True).alias("known_"), *[F.col(f).alias(f"{f}_declared") for f in fields])
    cells = [F.struct(F.lit("not declared").alias("rule"), F.col("known_").isNull().alias("bad"), F.lit(None).cast("string").alias("detail"))]
    cells += [F.struct(F.lit(f).alias("rule"), (F.col("known_") & ~F.col(f).eqNullSafe(F.col(f"{f}_declared"))).alias("bad"), F.col(f).cast("string").alias("detail")) for f in fields]
    broken = F.filter(F.array(*cells), lambda x: F.coalesce(x["bad"], F.lit(False)))
    return rows.join(F.broadcast(known), keys, "left").select(*kept, *keys, F.explode(broken).alias("v_")).select(*kept, *keys, "v_.rule", "v_.detail")


def differences(stored: DataFrame, computed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key-by-key comparison of two tables: status and absolute difference."""
    a, b = stored.select(*keys, F.col(value).alias("stored")), computed.select(*keys, F.col(value).alias("computed"))
    status = F.when(F.col("computed").isNull(), "stored only").when(F.col("stored").isNull(), "computed only").otherwise("both")
    return a.join(b, keys, "full").select(*keys, status.alias("status"), F.abs(F.col("stored") - F.col("computed")).alias("difference"))


def bindings(actual: DataFrame, bound: DataFrame, *keys: str) -> DataFrame:
    """Keys whose declared value isn't the actual one: 'not bound', 'not there' or 'differs'. Both: keys and value."""
    a, b = actual.select(*keys, F.col("value").alias("actual"), F.lit(True).alias("in_actual")), bound.select(*keys, F.col("value").alias("bound"), F.lit(True).alias("in_bound"))
    problem = F.when(F.col("in_bound").isNull(), "not bound").when(F.col("in_actual").isNull(), "not there").when(~F.col("actual").eqNullSafe(F.col("bound")), "differs")
    return a.join(b, list(keys), "full").select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def rederived(stored: DataFrame, computed: DataFrame, *keys: str, tolerance: float = 1e-9) -> DataFrame:
    """Stored summaries (keys, value) that differ from the computed ones by more than the tolerance, or that only one side has."""
    both = stored.select(*keys, F.col("value").alias("stored")).join(computed.select(*keys, F.col("value").alias("computed")), list(keys), "full")
    return both.where(F.col("stored").isNull() | F.col("computed").isNull() | (F.abs(F.col("stored") - F.col("computed")) > tolerance))


def _broken(rows: DataFrame, rules: dict[str, Column], *kept: str) -> DataFrame:
    bad = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("bad")) for k, v in rules.items()]), lambda x: x["bad"])
    return rows.select(*kept, F.explode(F.transform(bad, lambda x: x["rule"])).alias("rule"))


def pairing(predictions: DataFrame, models: tuple[str, ...], target: str, flags: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
    """(entity_key, target_period, rule): models that are missing, targets, flags or groups that differ between models."""
    kinds = lambda columns: F.countDistinct(F.struct(*columns))
    found = predictions.groupBy("entity_key", "target_period").agg(F.countDistinct("model").alias("models"), kinds([target]).alias("targets"), kinds(flags).alias("flags"), kinds(groups).alias("groups"))
    return _broken(found, {"models missing": F.col("models") != len(models), "targets differ": F.col("targets") > 1, "flags differ": F.col("flags") > 1, "groups differ": F.col("groups") > 1}, "entity_key", "target_period")


def roles(rows: DataFrame, rule: str = "several roles") -> DataFrame:
    """(rule, item, detail) of the items (item, value) with more than one value."""
    found = rows.groupBy("item").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)
    return found.select(F.lit(rule).alias("rule"), F.col("item").cast("string").alias("item"), F.array_join("values", ", ").alias("detail"))


def release_dates(rows: DataFrame) -> DataFrame:
    """Releases (release, published) with several dates, and those whose date isn't later than that of the release before."""
    own = rows.groupBy("release").agg(F.min("published").alias("published"))
    late = own.withColumn("before", F.lag("published").over(Window.orderBy("release"))).where(F.col("published") <= F.col("before"))  # one row a release
    order = late.select(F.lit("order of dates").alias("rule"), F.col("release").cast("string").alias("item"), F.col("published").alias("detail"))
    return roles(rows.select(F.col("release").alias("item"), F.col("published").alias("value")), "several dates").unionByName(order)
