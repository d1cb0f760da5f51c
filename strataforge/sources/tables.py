"""Tables of the panel study, derived from the star-schema tables by arithmetic (see FIXTURES.md).

Each function takes (spark, sf_dir). Tables that many operators read are persisted once per session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRATA = ("overall", "low", "medium", "high", "hard-to-place")
SUBSTRATA = STRATA[1:]
LAST_PERIOD = 2000
#: The last year of the tables is published once, the earlier ones twice.
LAST_RELEASE = 2002
_SAVED: dict[tuple, DataFrame] = {}


def saved(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f.__name__)
        if key not in _SAVED:
            _SAVED[key] = f(spark, sf_dir).persist()
        return _SAVED[key]

    return once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task joins and counts. A task's groups are nearly as many as its lines, so its memory grows with them.
LINES = 1_000_000


def with_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """`lines` joined with their orders, by l_orderkey and o_orderkey; no task gets more than about LINES lines, whatever spark.sql.shuffle.partitions says."""
    parts = -(-lines.count() // LINES)  # from the files' footers
    if parts > lines.sparkSession.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def supplier_code(key: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 6, "0"))


def in_stratum(stratum: str) -> Column:
    q = F.col("l_quantity")
    return {"overall": F.lit(True), "low": q <= 16, "medium": (q > 16) & (q <= 33), "high": q > 33, "hard-to-place": F.col("l_discount") >= 0.0799}[stratum]


@saved
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity, period and stratum: n, observed, expected, ratio, lower, upper."""
    lines = read(spark, sf_dir, "lineitem").withColumn("period", F.year("l_shipdate"))
    counted = lines.groupBy("l_suppkey", "l_linestatus", "period").agg(
        *[F.count_if(in_stratum(s)).alias(f"n{i}") for i, s in enumerate(STRATA)],
        *[F.count_if(in_stratum(s) & (F.col("l_returnflag") == "N")).alias(f"o{i}") for i, s in enumerate(STRATA)],
    )
    long = counted.select("l_suppkey", "l_linestatus", "period", F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("observed")) for i, s in enumerate(STRATA)])).alias("s")).select("l_suppkey", "l_linestatus", "period", "s.*")
    rates = long.groupBy("period", "stratum").agg((F.sum("observed") / F.nullif(F.sum("n"), F.lit(0))).alias("rate"))
    joined = long.join(F.broadcast(rates), ["period", "stratum"])
    gap = (F.col("period") > 1995) & ((F.col("l_suppkey") * 7 + F.col("period")) % 23 == 0)
    kept = joined.where(~gap).withColumn("expected", F.round(F.col("n") * F.col("rate"), 2))
    raw = (F.col("observed") + 2.0) / (F.col("expected") + 2.0)
    reach = F.exp(1.96 / F.sqrt(F.col("observed") + 2.0))
    shown = (F.col("stratum") == "overall") | (F.col("n") >= 8)
    return kept.select(
        F.concat_ws(":", supplier_code(F.col("l_suppkey")), "l_linestatus").alias("entity_key"), "period", "stratum", "n", "observed", "expected",
        F.when(shown, F.round(raw, 4)).alias("ratio"), F.when(shown, F.round(raw / reach, 4)).alias("lower"), F.when(shown, F.round(raw * reach, 4)).alias("upper"), "l_suppkey",
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per period: the release that publishes it, with the precision of its date."""
    periods = signals(spark, sf_dir).select("period").distinct()
    day = F.col("period") % 2 == 1
    return periods.select("period", F.col("period").alias("release"), F.concat((F.col("period") + 1).cast("string"), F.when(day, "-07-07").otherwise("-07")).alias("published_value"), F.when(day, "day").otherwise("month").alias("published_precision"))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest attributes of each supplier code; some names are blank and some suppliers are absent."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.where(F.col("s_suppkey") % 13 != 0).join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(supplier_code(F.col("s_suppkey")).alias("code"), F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.col("s_name")).alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def wide_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as published: <stratum>_<measure> columns, thousands separators, marks for missing values, mixed case."""
    s = signals(spark, sf_dir)
    mark = F.element_at(F.array(F.lit(""), F.lit("-"), F.lit("N/A"), F.lit(".")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    shown = {"n": F.format_number("n", 0), "observed": F.format_number("observed", 0), "expected": F.format_number("expected", 2), "ratio": F.col("ratio").cast("string"), "lower": F.col("lower").cast("string"), "upper": F.col("upper").cast("string")}
    texts = s.select("entity_key", "period", "stratum", "l_suppkey", *[F.coalesce(v, mark).alias(k) for k, v in shown.items()])
    columns = [F.max(F.when(F.col("stratum") == t, F.col(m))).alias(f"{t.replace('-', '_')}_{m}") for t in STRATA for m in shown]
    code, kind = F.split("entity_key", ":")[0], F.split("entity_key", ":")[1]
    low = F.col("l_suppkey") % 5 == 0
    return texts.groupBy("entity_key", "period", "l_suppkey").agg(*columns).select(F.when(low, F.lower(code)).otherwise(code).alias("code"), F.when(low, F.lower(kind)).otherwise(kind).alias("kind"), "period", *[f"{t.replace('-', '_')}_{m}" for t in STRATA for m in shown])


REMOVALS = [f"r{i}" for i in range(8)]


@saved
def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock and flow of each supplier and year, in two vintages: start, end, additions and eight removal counts."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    q = F.col("l_quantity")
    slot = F.least(F.lit(7), 3 * F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) + F.when(q <= 16, 0).when(q <= 33, 1).otherwise(2))
    out = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(*[F.count_if(slot == i).alias(f"r{i}") for i in range(8)])
    come = with_orders(lines.select("l_suppkey", "l_orderkey"), orders).groupBy("l_suppkey", "year").agg(F.count("*").alias("additions"))
    flows = come.join(out, ["l_suppkey", "year"], "full").fillna(0, ["additions", *REMOVALS])
    gone = sum((F.col(r) for r in REMOVALS), F.lit(0))
    from pyspark.sql import Window

    before = Window.partitionBy("l_suppkey").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    stock = flows.withColumn("start", 200 + F.coalesce(F.sum(F.col("additions") - gone).over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("additions") - gone)
    k, y = F.col("l_suppkey"), F.col("year")
    twice = stock.withColumn("release", F.explode(F.array(F.col("year") + 1, F.col("year") + 2))).where(F.col("release") <= LAST_RELEASE)
    later = F.col("release") == F.col("year") + 2
    broken, off, revised = (5 * k + y) % 17 == 0, (13 * k + y) % 29 == 0, later & ((k + y) % 5 == 0)
    two = F.when(broken, 2).otherwise(0)
    one = F.when(revised, 1).otherwise(0)
    return twice.where(later | ((3 * k + y) % 41 != 0)).select(
        F.concat(supplier_code(k), F.lit(":TX")).alias("entity_key"), "year", "release", (F.col("start") + two).alias("start"), (F.col("end") + two + F.when(off, 1).otherwise(0) + one).alias("end"), (F.col("additions") + one).alias("additions"),
        *[F.when((11 * k + y) % 37 == 0, None).otherwise(F.col(r)).alias(r) if r == "r7" else F.col(r) for r in REMOVALS],
    )


STATUSES = ("NF", "NO", "AF", "AO", "RF", "RO")


@saved
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of orders by release: n, percentages of six disjoint statuses, published total of the successes."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("status"), "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    dated = orders.withColumn("release", F.year(F.add_months("day", 6)) + 1)
    counted = with_orders(lines, dated).groupBy("release", "l_suppkey", "priority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), *[F.count_if(F.col("status") == s).alias(f"c_{s}") for s in STATUSES])
    percent = [(100.0 * F.col(f"c_{s}") / F.col("n")).alias(s) for s in STATUSES]
    return counted.select(
        "release", F.concat(supplier_code(F.col("l_suppkey")), F.lit(":P"), "priority").alias("entity_key"), "n", "quantity", F.col("c_NF").alias("success_nf"), (F.col("c_NF") + F.col("c_NO")).alias("successes"), *percent,
        F.round(100.0 * (F.col("c_NF") + F.col("c_NO")) / F.col("n"), 1).alias("published_total"), "l_suppkey",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature and target releases, two years apart, of the outcomes that there are, with their cohort windows."""
    releases = outcomes(spark, sf_dir).select("release").distinct()
    rows = releases.select(F.col("release").alias("feature_release")).join(F.broadcast(releases.select(F.col("release").alias("target_release"))), F.col("target_release") == F.col("feature_release") + 2)
    return rows.select(
        "*", F.make_date(F.col("feature_release") - 2, F.lit(7), F.lit(1)).alias("feature_start"), F.make_date(F.col("feature_release") - 1, F.lit(6), F.lit(30)).alias("feature_end"),
        F.make_date(F.col("target_release") - 2, F.lit(7), F.lit(1)).alias("target_start"), F.make_date(F.col("target_release") - 1, F.lit(6), F.lit(30)).alias("target_end"),
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per release of the outcomes: what its date of publication says, by day or by month."""
    day = F.col("release") % 2 == 1
    return outcomes(spark, sf_dir).select("release").distinct().select("release", F.concat(F.col("release").cast("string"), F.when(day, "-07-07").otherwise("-07")).alias("published_value"), F.when(day, "day").otherwise("month").alias("published_precision"))


@saved
def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, waits and safety of each release and entity; some rows and some measures aren't reported."""
    o = outcomes(spark, sf_dir).withColumn("events", F.round((F.col("RF") + F.col("RO")) * F.col("n") / 100.0).cast("long"))
    totals = o.groupBy("release").agg((F.sum("successes") / F.sum("n")).alias("rate"), (F.sum("events") / F.sum("n")).alias("event_rate"))
    k, r = F.col("l_suppkey"), F.col("release")
    expected, harm = F.round(F.col("n") * F.col("rate"), 2), F.round(F.col("n") * F.col("event_rate"), 2)
    ratio, reach = (F.col("events") + 2.0) / (harm + 2.0), F.exp(1.96 / F.sqrt(F.col("events") + 2.0))
    there = (k + 2 * r) % 13 != 0
    return o.join(F.broadcast(totals), "release").where((3 * k + r) % 31 != 0).select(
        "release", "entity_key", F.round(F.col("quantity") / 10.0, 3).alias("person_years"), F.when((k + r) % 10 != 1, F.round((F.col("successes") + 2.0) / (expected + 2.0), 4)).alias("rate_ratio"),
        F.when((k + r) % 9 == 0, ">28").otherwise((1 + (k * 3 + r) % 28).cast("string")).alias("wait_text"), F.when(there, F.round(ratio, 4)).alias("safety_ratio"), F.when(there, F.round(ratio / reach, 4)).alias("safety_lower"), F.when(there, F.round(ratio * reach, 4)).alias("safety_upper"),
    )


def forget() -> None:
    """Releases all tables that were kept by `saved`."""
    while _SAVED:
        _SAVED.popitem()[1].unpersist()
