"""Releases that arrive as a stream: the rows of each vintage once, and late repeats dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_vintages(stream: DataFrame, delay: str, time_col: str = "published") -> DataFrame:
    """Each (entity, year, release) once, while its repeats come at most `delay` late; state older than that is forgotten."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["entity_key", "year", "release"])
