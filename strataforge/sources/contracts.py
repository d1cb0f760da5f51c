"""The declared schema of a stored table against the footers of all its files, read in tasks: what differs is a row."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stores whose files a task opens by itself, so that only footers are read; files of others come through Spark as a whole.
OPENED = ("file", "hdfs", "s3", "gs")
FOOTERS = "file string, file_rows long, column string, type string"


def _footer(path: str, content: bytes | None) -> tuple[pa.Schema, int]:
    if content is not None:
        found = pq.ParquetFile(pa.BufferReader(content))
    else:
        local = re.sub("^file:/+", "/", path)
        store, place = (pyarrow.fs.LocalFileSystem(), local) if local != path else pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/"))
        found = pq.ParquetFile(place, filesystem=store)
    return found.schema_arrow, found.metadata.num_rows


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_rows, column, type) of every column of every Parquet file below `path`; types as Spark writes them. Columns that folders name aren't in files."""
    from pyspark.sql.pandas.types import from_arrow_type

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    scheme = F.regexp_extract("path", "^([a-z0-9]+):", 1)
    own, whole = listed.where(scheme.isin(*OPENED)).select("path", F.lit(None).cast("binary").alias("content")), listed.where(~scheme.isin(*OPENED)).select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                schema, rows = _footer(file, content)
                columns = [[file] * len(schema), [rows] * len(schema), schema.names, [from_arrow_type(t).simpleString() for t in schema.types]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "file_rows", "column", "type"])

    return own.repartition("path").unionByName(whole).mapInArrow(run, FOOTERS)


def schema_violations(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, column, rule, detail): columns that a file lacks, has beyond the declared ones, or has with another type. Order and nullability don't count."""
    found = footers(spark, path)
    declared = F.broadcast(spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column string, wanted string"))
    files = found.select("file").distinct()
    asked = files.join(declared).where(~F.contains("file", F.concat(F.lit("/"), "column", F.lit("="))))  # columns of folders are in no file; the declared ones are a short list
    both = asked.join(found.select("file", "column", "type"), ["file", "column"], "full")
    rule = F.when(F.col("type").isNull(), "missing column").when(F.col("wanted").isNull(), "column not declared").when(F.col("type") != F.col("wanted"), "type differs")
    return both.select("file", "column", rule.alias("rule"), F.when(F.col("wanted").isNotNull() & F.col("type").isNotNull(), F.concat_ws(" instead of ", "type", "wanted")).alias("detail")).where(F.col("rule").isNotNull())


def release_sizes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, rows, columns) of each folder <key>=... below `path`, from the footers: rows of all files, and the columns that all of them have."""
    named = footers(spark, path).withColumn(key, F.regexp_extract("file", f"/{key}=([^/]+)/", 1))
    files = named.groupBy(key, "file").agg(F.first("file_rows").alias("file_rows"))
    total = files.groupBy(key).agg(F.sum("file_rows").alias("rows"), F.count("*").alias("files"))
    shared = named.groupBy(key, "column").agg(F.count("*").alias("in_files")).join(total, key).groupBy(key).agg(F.count_if(F.col("in_files") == F.col("files")).alias("columns"))
    return total.join(shared, key).select(key, "rows", "columns")
