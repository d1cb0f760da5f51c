"""Reading and writing of stored tables with a fixed schema and a stable order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import contracts

PREDICTIONS = StructType([
    StructField("entity_key", StringType()), StructField("feature_period", IntegerType()), StructField("target_period", IntegerType()), StructField("model", StringType()), StructField("n", LongType()), StructField("quartile", IntegerType()),
    *[StructField(c, DoubleType()) for c in ("target_ratio", "target_log", "predicted_log", "predicted_ratio")],
])


def write_table(df: DataFrame, path: str, order: list[str], partition: str) -> None:
    """Parquet with zstd, one folder per value of `partition`, rows of each file in `order`.

    Rows are dealt by the partition column and rebalanced by their measured size (spark.sql.adaptive.advisoryPartitionSizeInBytes): a large value is
    written by as many tasks as it needs, small ones share a task.
    """
    df.hint("rebalance", F.col(partition)).sortWithinPartitions(partition, *order).write.partitionBy(partition).option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def read_exact(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table, if the columns and types of every file are the declared ones (their order and nullability don't count)."""
    wrong = contracts.schema_violations(spark, path, schema).limit(5).collect()
    if wrong:
        raise ValueError(f"schema of {path} differs: " + "; ".join(f"{r.file}: {r.column}: {r.rule} {r.detail or ''}".strip() for r in wrong))
    return spark.read.schema(schema).parquet(path)


def scan_panel(spark: SparkSession, path: str, schema: StructType, last_target: int) -> DataFrame:
    """Rows with target periods up to `last_target`; the condition prunes partitions or reaches the scan."""
    return read_exact(spark, path, schema).where(F.col("target_period") <= last_target)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """The stable columns of a table of predictions, a folder for each target period."""
    stable = predictions.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS])
    write_table(stable, path, ["entity_key", "model"], "target_period")


def read_releases(spark: SparkSession, path: str, releases: DataFrame) -> DataFrame:
    """All releases below `path` (folders release=...), each row with its release's metadata and the folder it came from."""
    found = spark.read.parquet(path).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), "(release=[^/]+)/[^/]+$", 1))
    return found.join(F.broadcast(releases.select("release", "published_value", "published_precision")), "release")
