"""Stock and flow: vintages, revisions, accounts, year-over-year contributions, summaries over entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.lineage import cut
from ..sources.tables import REMOVALS
from . import ranks

FIELDS = ("start", "end", "additions", *REMOVALS)


def plus(*columns: Column) -> Column:
    """A sum that is null if any part is."""
    return reduce(lambda a, b: a + b, columns)


def earliest_vintage(annual: DataFrame) -> DataFrame:
    """Rows of each year's first release, chosen for all entities together: an entity that it lacks stays missing."""
    first = annual.groupBy("year").agg(F.min("release").alias("first_release"))  # one row a year
    return annual.join(F.broadcast(first), "year").where(F.col("release") == F.col("first_release"))


def with_accounts(rows: DataFrame) -> DataFrame:
    growth, removed = F.col("end") - F.col("start"), plus(*[F.col(r) for r in REMOVALS])
    return rows.withColumns({"growth": growth, "removal_total": removed, "residual": growth - F.col("additions") + removed})


def revisions(annual: DataFrame) -> DataFrame:
    """Each year's first vintage against every later one, with the names of the fields that changed."""
    first = earliest_vintage(annual)
    years = annual.groupBy("year").agg(F.min("release").alias("first_release"))
    later = annual.join(F.broadcast(years), "year").where(F.col("release") > F.col("first_release"))
    versions = annual.join(F.broadcast(years), "year").where(F.col("release") > F.col("first_release")).select("year", F.col("release").alias("later_release")).distinct()
    old = first.join(F.broadcast(versions), "year").select("entity_key", "year", "later_release", F.lit(True).alias("in_first"), *[F.col(f).alias(f"old_{f}") for f in FIELDS])
    new = later.select("entity_key", "year", F.col("release").alias("later_release"), F.lit(True).alias("in_later"), *[F.col(f).alias(f"new_{f}") for f in FIELDS])
    both = old.join(new, ["entity_key", "year", "later_release"], "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), f) for f in FIELDS]))
    status = F.when(F.col("in_later").isNull(), "withdrawn").when(F.col("in_first").isNull(), "added").when(F.size(changed) > 0, "revised").otherwise("unchanged")
    return both.select("entity_key", "year", "later_release", status.alias("status"), F.when(F.col("in_first") & F.col("in_later"), F.array_join(changed, ",")).otherwise("").alias("changed_fields"))


def compared(accounts: DataFrame) -> DataFrame:
    """Each year with the one before: changes, signed contributions (old - new), and the first reason to leave the pair out."""
    before = accounts.select("entity_key", (F.col("year") + 1).alias("year"), *[F.col(c).alias(f"p_{c}") for c in ("start", "end", "additions", "growth", "removal_total", "residual", *REMOVALS)])
    both = accounts.join(before, ["entity_key", "year"])
    reason = (
        F.when(F.col("removal_total").isNull() | F.col("p_removal_total").isNull(), "missing").when((F.col("residual") != 0) | (F.col("p_residual") != 0), "residual")
        .when(F.col("p_end") != F.col("start"), "boundary").when((F.col("start") <= 0) | (F.col("p_start") <= 0), "zero")
    )
    return both.withColumns({
        "growth_change": F.col("growth") - F.col("p_growth"), "additions_change": F.col("additions") - F.col("p_additions"), "reason": reason,
        **{f"contrib_{r}": F.col(f"p_{r}") - F.col(r) for r in REMOVALS},
    })


def coverage(accounts: DataFrame) -> DataFrame:
    """Per year: entities, clean rows, missing cells, residuals, zero starts, newly seen, apparent exits, and those matched with the year before."""
    order = Window.partitionBy("entity_key").orderBy("year")
    rows = accounts.withColumns({"first_year": F.min("year").over(Window.partitionBy("entity_key")), "next_year": F.lead("year").over(order), "last_year": F.lag("year").over(order)})
    return rows.groupBy("year").agg(
        F.count("*").alias("entities"), F.count_if(F.col("residual") == 0).alias("clean"), F.count_if(F.col("removal_total").isNull()).alias("missing"), F.count_if(F.col("residual") != 0).alias("residuals"),
        F.count_if(F.col("start") == 0).alias("zero_start"), F.count_if(F.col("year") == F.col("first_year")).alias("newly_seen"), F.count_if(~F.col("next_year").eqNullSafe(F.col("year") + 1)).alias("exits"), F.count_if(F.col("last_year") == F.col("year") - 1).alias("matched"),
    )


def count_metrics() -> dict[str, Column]:
    """Counts of a compared row and their changes (new - old); the first two removals are the focus, also as one."""
    change = lambda r: -F.col(f"contrib_{r}")
    found = {"growth": F.col("growth"), "change_growth": F.col("growth_change"), "additions": F.col("additions"), "change_additions": F.col("additions_change"), "focus": plus(*[F.col(r) for r in REMOVALS[:2]]), "change_focus": plus(*[change(r) for r in REMOVALS[:2]])}
    for r in REMOVALS:
        found |= {r: F.col(r), f"change_{r}": change(r)}
    return found


def median_of_medians(usable: DataFrame, *by: str) -> DataFrame:
    """Median over entities of each entity's median, for all counts and for counts per 100 at the start."""
    counts = count_metrics()
    rows = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in counts.items()] + [F.struct(F.lit(f"{k}_per100").alias("metric"), C.per100(v, F.col("start")).alias("value")) for k, v in counts.items()]
    own = usable.select(*by, "entity_key", F.explode(F.array(*rows)).alias("m_")).groupBy(*by, "entity_key", "m_.metric").agg(F.percentile("m_.value", F.lit(0.5)).alias("own"))
    own = cut(own)  # read for counts, then for the medians over entities
    counted = own.groupBy(*by, "metric").agg(F.count("own").alias("entities"))
    middle = ranks.percentiles(own, [*by, "metric"], "own", [0.5]).select(*by, "metric", F.col("p")[0].alias("median"))
    return counted.join(F.broadcast(middle), [*by, "metric"], "left")


def prevalence(usable: DataFrame, indicators: dict[str, Column]) -> DataFrame:
    """Mean over entities of each entity's mean indicator."""
    own = usable.groupBy("entity_key").agg(*[F.avg(v.cast("double")).alias(k) for k, v in indicators.items()])
    return own.agg(F.count("*").alias("entities"), *[F.avg(k).alias(k) for k in indicators])


def longest_run(years: DataFrame) -> DataFrame:
    """First and last year and length of each entity's last longest run of consecutive years."""
    island = F.col("year") - F.row_number().over(Window.partitionBy("entity_key").orderBy("year"))
    runs = years.select("entity_key", "year", island.alias("island")).groupBy("entity_key", "island").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("years"))
    best = runs.groupBy("entity_key").agg(F.max(F.struct("years", "last_year", "first_year")).alias("b"))
    return best.select("entity_key", "b.first_year", "b.last_year", "b.years")


def in_all_years(rows: DataFrame, year: str = "year") -> DataFrame:
    """Entities that have a row in every year of the table."""
    wanted = rows.agg(F.countDistinct(year).alias("wanted"))
    return rows.groupBy("entity_key").agg(F.countDistinct(year).alias("years")).join(F.broadcast(wanted)).where(F.col("years") == F.col("wanted")).select("entity_key", "years")


def reconcile(parts: list[Column], total: Column, step: float, whole: list[Column] | None = None) -> dict[str, Column]:
    """Whether a published total lies within the rounding of its parts: intervals of half a step, cut to 0 to 100, with 1e-10 to spare.

    whole: all parts of 100; their intervals' sum has to contain 100.
    """
    low = lambda c: F.greatest(F.lit(0.0), c - step / 2)
    high = lambda c: F.least(F.lit(100.0), c + step / 2)
    floor, top = plus(*[low(p) for p in parts]), plus(*[high(p) for p in parts])
    return {"parts_low": floor, "parts_high": top, "total_low": low(total), "total_high": high(total), "reconciles": (floor <= high(total) + C.TIE) & (low(total) <= top + C.TIE)} | (
        {"whole_low": plus(*map(low, whole)), "whole_high": plus(*map(high, whole)), "whole_reconciles": (plus(*map(low, whole)) <= 100 + C.TIE) & (100 - C.TIE <= plus(*map(high, whole)))} if whole else {}
    )


SIZES = {"under 100": (None, 100), "100 to 499": (100, 500), "500 or more": (500, None)}
#: Thresholds of the screen; a run of YEARS consecutive usable years is needed.
SCREEN = {"years": 3, "pairs": 5, "coverage": 0.5, "growing": 2, "common": 3, "common_growing": 1, "size_growing": 1, "prevalence": 0.5, "size_prevalence": 0.4, "growth": 1, "growth_per100": 0.1}


def screen_summaries(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: observations, growing entities, prevalence of more focus removals among them, and the median growth where they rose; every entity has one weight."""
    more = F.col("change_focus") > 0
    base = rows.withColumn("change_focus", count_metrics()["change_focus"])
    growing = base.where(F.col("growth") > 0)
    counts = base.groupBy(*by).agg(F.count("*").alias("observations"), F.countDistinct("entity_key").alias("entities"))
    share = growing.groupBy(*by, "entity_key").agg(F.avg(more.cast("double")).alias("own")).groupBy(*by).agg(F.count("*").alias("growing"), F.avg("own").alias("prevalence"))
    rose = growing.where(more).groupBy(*by, "entity_key").agg(F.percentile("growth", F.lit(0.5)).alias("g"), F.percentile(C.per100(F.col("growth"), F.col("start")), F.lit(0.5)).alias("h"))
    both = rose.unpivot([*by, "entity_key"], ["g", "h"], "which", "value")
    size = ranks.percentiles(both, [*by, "which"], "value", [0.5]).groupBy(*by).agg(*[F.max(F.when(F.col("which") == k, F.col("p")[0])).alias(name) for k, name in (("g", "growth"), ("h", "growth_per100"))])
    join = lambda a, b: a.join(b, list(by), "left")
    return join(join(counts, share), size).withColumn("growing", F.coalesce("growing", F.lit(0)))


def screen_table(usable: DataFrame, matched: DataFrame, limits: dict[str, float] = SCREEN) -> DataFrame:
    """The groups that the screen looks at (kind, cut, ...) with `enough` rows and `material` findings.

    matched: (year, matched), pairs that could be compared at best. Years are usable by coverage alone; the last run of
    `years` usable years is the recurrence; common entities (present in all of them) and sizes are cut from these years.
    """
    annual = screen_summaries(usable, "year").join(F.broadcast(matched), "year", "left")
    seen = annual.withColumn("usable", (F.col("observations") >= limits["pairs"]) & (F.col("matched") >= F.col("observations")) & (F.col("observations") / F.col("matched") >= limits["coverage"]) & (F.col("growing") >= limits["growing"]))
    ok = seen.where(F.coalesce("usable", F.lit(False))).select("year")
    before = ok.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(limits["years"] - 1)), lambda k: F.col("year") + k)).alias("last"))
    last = before.groupBy("last").count().where(F.col("count") == limits["years"]).agg(F.max("last").alias("last"))
    recent = usable.join(F.broadcast(last), F.col("year").between(F.col("last") - limits["years"] + 1, F.col("last"))).drop("last")
    common = in_all_years(recent)
    whole = recent.join(common.select("entity_key"), "entity_key", "left_semi")
    start = F.col("start")
    cut = F.coalesce(*[F.when((start >= lo if lo else F.lit(True)) & (start < hi if hi else F.lit(True)), name) for name, (lo, hi) in SIZES.items()])
    material = (F.col("prevalence") >= limits["prevalence"]) & (F.coalesce("growth", F.lit(0.0)) >= limits["growth"]) & (F.coalesce("growth_per100", F.lit(0.0)) >= limits["growth_per100"])
    sized = (F.col("prevalence") >= limits["size_prevalence"]) & (F.coalesce("growth_per100", F.lit(0.0)) >= limits["growth_per100"])
    size_rows = screen_summaries(recent.withColumn("cut", cut), "cut")
    sizes = usable.sparkSession.createDataFrame([(n,) for n in SIZES], "cut string").join(size_rows, "cut", "left").fillna(0, ["observations", "entities", "growing"])
    shape = lambda df, kind, cut, enough, rule: df.select(F.lit(kind).alias("kind"), cut.cast("string").alias("cut"), "observations", "entities", "growing", "prevalence", "growth", "growth_per100", enough.alias("enough"), F.coalesce(rule, F.lit(False)).alias("material"))
    chosen = seen.join(F.broadcast(last), F.col("year").between(F.col("last") - limits["years"] + 1, F.col("last")), "left_semi")
    rest = seen.join(F.broadcast(last), F.col("year").between(F.col("last") - limits["years"] + 1, F.col("last")), "left_anti")
    enough_common = (F.col("growing") >= limits["common_growing"]) & (F.col("entities") >= limits["common"])
    tables = [shape(chosen, "recurrence", F.col("year"), F.col("usable"), material), shape(rest, "other year", F.col("year"), F.coalesce("usable", F.lit(False)), material), shape(screen_summaries(whole, "year"), "common", F.col("year"), enough_common, material), shape(sizes, "size", F.col("cut"), F.col("growing") >= limits["size_growing"], sized)]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


def screen_verdict(table: DataFrame, years: int = 3) -> DataFrame:
    """One row: 'inconclusive' without a run of usable years or enough common entities and sizes, else 'continue' if every finding is material, else 'stop'."""
    asked = F.col("kind") != "other year"
    found = table.agg(F.count_if(F.col("kind") == "recurrence").alias("recurrence_years"), F.count_if(F.col("kind") == "common").alias("common_years"), F.coalesce(F.min(F.when(asked, F.col("enough"))), F.lit(False)).alias("enough"), F.coalesce(F.min(F.when(asked, F.col("material"))), F.lit(False)).alias("material"))
    run, covered = F.col("recurrence_years") >= years, F.col("enough") & (F.col("common_years") >= years)
    reason = F.when(~run, "fewer consecutive usable years than asked").when(~covered, "too few common entities or sizes").when(F.col("material"), "all criteria pass").otherwise("a magnitude or recurrence criterion fails")
    verdict = F.when(~run | ~covered, "inconclusive").when(F.col("material"), "continue").otherwise("stop")
    return found.select("recurrence_years", verdict.alias("verdict"), reason.alias("reason"))
