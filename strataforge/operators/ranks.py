"""Exact ranks and order statistics of groups that may be as large as the table: no group is sorted or held by one task.

`ranked` sorts by ranges and adds the rows of earlier ranges. `order_values` brackets each wanted rank by a sketch, counts what
lies below, and looks only at the distinct values inside the bracket; the rank is then exact whatever the sketch's error, which is half the
bracket's reach at most. Sketches of one group differ with the order in which parts of it arrive, so counts and values come from one pass behind one bracket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut

#: The sketches' relative accuracy is 1 / ACCURACY of a group's rows.
ACCURACY = 100_000


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """`df` with each row's rank in its group (from 1, in the columns of `order`) and the group's size.

    Rows are shuffled once, by the sort: a row's place among its group's rows of one sorted range is its number in the range less that of the
    group's first there, and the group's rows in earlier ranges are a row for each range that the group lies in, which is broadcast.
    """
    placed = cut(df.sort(*by, *order).withColumn("number_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("number_", 33)))
    sizes = placed.groupBy(*by, "part_").agg(F.count("*").alias("rows_"), F.min("number_").alias("first_"))
    of = Window.partitionBy(*by)  # one row a range that the group lies in
    offsets = sizes.withColumns({"before_": F.coalesce(F.sum("rows_").over(of.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), size: F.sum("rows_").over(of)})
    own = placed.withColumnRenamed("number_", "place_")
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "part_"]]
    joined = own.alias("p").join(F.broadcast(offsets.alias("o")), keys)
    return joined.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("before_") + F.col("place_") - F.col("first_") + 1).alias(rank), F.col(size))


def order_values(df: DataFrame, by: list[str], value: str, near: list[float], ranks: Callable[[Column], list[Column]], small: bool = True) -> DataFrame:
    """(by, n, values): the values at the wanted ranks of each group, nulls left out.

    near: a part p for each wanted rank; the rank (from 1, a function of n) may be at most one beyond p * n, rounded either way.
    small: the groups are so few that a row for each can be broadcast.
    """
    rows = df.select(*by, F.col(value).alias("v_")).where(F.col("v_").isNotNull())
    k, step = len(near), 2.0 / ACCURACY
    points = [min(1.0, max(0.0, p + d)) for p in near for d in (-step, step)]
    found = rows.groupBy(*by).agg(F.percentile_approx("v_", F.array(*[F.lit(p) for p in points]), ACCURACY).alias("q_"))
    low, high = (lambda i: F.col("q_")[2 * i]), (lambda i: F.col("q_")[2 * i + 1])
    joined = _with(rows, found, by, small)
    v = F.col("v_")
    side = F.array(*[F.when(v < low(i), -1).when(v > high(i), 1).otherwise(0) for i in range(k)])
    cells = joined.groupBy(*by, side.alias("side_"), F.when(F.array_contains(side, 0), v).alias("v_")).agg(F.count("*").alias("c_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
    on = lambda i, s, c: F.when(F.col("side_")[i] == s, c)
    whole = cells.groupBy(*by).agg(
        F.coalesce(F.sum("c_"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(on(i, -1, F.col("c_"))), F.lit(0)).alias(f"below_{i}") for i in range(k)], *[F.max(on(i, -1, F.col("most_"))).alias(f"left_{i}") for i in range(k)],
        *[F.min(on(i, 1, F.col("least_"))).alias(f"right_{i}") for i in range(k)], *[F.sort_array(F.collect_list(on(i, 0, F.struct("v_", "c_")))).alias(f"list_{i}") for i in range(k)],
    )
    wanted = ranks(F.col("n"))

    def at(i: int) -> Column:
        rest = wanted[i] - F.col(f"below_{i}")
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step_ = lambda a, x: F.struct((a["seen"] + x["c_"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["c_"] >= rest), x["v_"].cast("double")).otherwise(a["v"]).alias("v"))
        got = F.aggregate(F.col(f"list_{i}"), start, step_)["v"]
        return F.when(rest < 1, F.col(f"left_{i}").cast("double")).otherwise(F.coalesce(got, F.col(f"right_{i}").cast("double")))

    return whole.select(*by, "n", F.array(*[at(i) for i in range(k)]).alias("values"))


def _with(left: DataFrame, right: DataFrame, by: list[str], small: bool = True) -> DataFrame:
    """Joined by group. small: `right`, a row for each group, is broadcast, so that large groups aren't dealt to a task each."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    return left.alias("l").join((F.broadcast(right) if small else right).alias("r"), on).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in by])


def percentiles(df: DataFrame, by: list[str], value: str, parts: list[float]) -> DataFrame:
    """(by, n, p): exact percentiles with linear interpolation between neighbours, as `percentile` gives them."""
    def both(n: Column) -> list[Column]:
        out = []
        for p in parts:
            first = F.floor(F.lit(p) * (n - 1)).cast("long") + 1
            out += [first, F.least(first + 1, n)]
        return out

    found = order_values(df, by, value, [p for p in parts for _ in range(2)], both)
    n, v = F.col("n"), F.col("values")

    def between(k: int, p: float) -> Column:
        share = F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
        return F.when(share == 0, v[2 * k]).otherwise((1 - share) * v[2 * k] + share * v[2 * k + 1])

    return found.select(*by, "n", F.array(*[between(k, p) for k, p in enumerate(parts)]).alias("p"))
