"""Stored summaries that know what they were made of: only parts whose source or stored rows have changed are derived again.

A part (a release, a period) has a version, its number of rows and the sum of their 64-bit hashes, which needs one scan without a sort; the
stored rows of a part have a seal of the same kind. Parts are a short list and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mark(*columns: str) -> Column:
    """Number and sum of the hashes of the rows of a group."""
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"))


def versions(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """(part, version) of what `columns` hold."""
    return rows.groupBy(part).agg(_mark(*sorted(columns)).alias("version"))


def sealed(summary: DataFrame, rows: DataFrame, part: str, columns: list[str], keys: list[str]) -> DataFrame:
    """`summary` (part, keys, value) with the version of the rows it was derived from and a seal, ready to be stored."""
    seals = summary.groupBy(part).agg(_mark(*keys, "value").alias("seal"))
    return summary.select(part, *keys, "value").join(F.broadcast(versions(rows, part, columns)), part).join(F.broadcast(seals), part)


def changed_parts(stored: DataFrame, rows: DataFrame, part: str, columns: list[str], keys: list[str]) -> DataFrame:
    """(part, problem): parts whose source isn't the stored version, that one side lacks, or whose stored rows don't fit their seal."""
    then = stored.groupBy(part).agg(F.min("version").alias("was"), F.min("seal").alias("seal"), _mark(*keys, "value").alias("found"))
    both = then.join(versions(rows, part, columns), part, "full")
    problem = F.when(F.col("was").isNull(), "not stored").when(F.col("version").isNull(), "source is gone").when(F.col("was") != F.col("version"), "source has changed").when(F.col("seal") != F.col("found"), "stored rows were altered")
    return both.select(part, problem.alias("problem")).where(F.col("problem").isNotNull())


def recheck(stored: DataFrame, rows: DataFrame, part: str, columns: list[str], keys: list[str], summarise: Callable[[DataFrame], DataFrame], tolerance: float = 1e-9) -> DataFrame:
    """(part, keys, problem, stored, computed) of the summaries that are no longer right; parts that haven't changed are not derived again."""
    changed = F.broadcast(changed_parts(stored, rows, part, columns, keys))
    again = summarise(rows.join(changed.select(part), part, "left_semi")).select(part, *keys, F.col("value").alias("computed"))
    held = stored.join(changed.select(part), part, "left_semi").select(part, *keys, F.col("value").alias("stored"))
    both = held.join(again, [part, *keys], "full").join(changed, part)
    wrong = F.col("stored").isNull() | F.col("computed").isNull() | (F.abs(F.col("stored") - F.col("computed")) > tolerance)
    return both.where(wrong).select(part, *keys, "problem", "stored", "computed")
