"""Closed intervals of time: pairs that overlap, and a sweep that tells what each interval meets, for any number of intervals.

Neither holds all intervals of a group in one task: overlaps are found within buckets of time, the sweep within sorted ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut


def overlaps(a: DataFrame, b: DataFrame, days: int = 366, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a (start_a, end_a, ...) and b (start_b, end_b, ...) whose days meet, ends included; within `by`, if given.

    Each row stands in every bucket of `days` days that it reaches; a pair is taken in the bucket of its later start alone, so it comes once.
    """
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)
    spread = lambda df, x: df.withColumn("bucket_", F.explode(F.sequence(number(F.col(f"start_{x}")), number(F.col(f"end_{x}")))))
    left, right = spread(a.where("start_a <= end_a"), "a"), spread(b.where("start_b <= end_b"), "b")
    joined = left.join(right, [*by, "bucket_"])
    meet = (F.col("start_a") <= F.col("end_b")) & (F.col("start_b") <= F.col("end_a"))
    return joined.where(meet & (F.col("bucket_") == number(F.greatest("start_a", "start_b")))).drop("bucket_")


def sweep(df: DataFrame, by: str, start: str, end: str, *ties: str, reach: str = "reach") -> DataFrame:
    """`df` with the latest end of all intervals of its group that start before (ties by `end` and `ties`); null for the first.

    Running maxima are taken within sorted ranges; what a range adds is the maximum of the group's earlier ranges, a row for each range that a group lies in, which is broadcast.
    """
    order = [start, end, *ties]
    placed = cut(df.sort(by, *order).withColumn("part_", F.spark_partition_id()))
    group = Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = placed.groupBy(by, "part_").agg(F.max(end).alias("own_")).withColumn("carried_", F.max("own_").over(group))
    before = Window.partitionBy(by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("before_", F.max(end).over(before))
    found: Column = F.greatest("before_", "carried_")
    return own.join(F.broadcast(carried.where(F.col("carried_").isNotNull()).select(by, "part_", "carried_")), [by, "part_"], "left").withColumn(reach, found).drop("part_", "before_", "carried_")
