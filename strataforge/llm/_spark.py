"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.lineage import cut, new_path

__all__ = ["cut", "extended", "map_rows", "new_path", "parts", "quoted", "read", "unused"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores as it takes to be none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """The name of a column, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def extended(schema: StructType, *more) -> StructType:
    """`schema` with further fields; names may hold any character."""
    return StructType([*schema.fields, *more])


def map_rows(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema), whatever characters the names hold."""
    names = df.columns

    def renamed(batches):
        return run(pa.RecordBatch.from_arrays(batch.columns, names=names) for batch in batches)

    made = df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, StructType([type(f)(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)]))
    return made.toDF(*schema.names)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
