"""The corpus pipeline: five of the training-data operators, one after another over `documents`.

Quality rules, language identification, near-duplicate removal, redaction of personal data, packing. Each stage works on
all that its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import language, neardup, packing, pii, quality, registry

ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or lie outside their language's perplexity bands go."""
    return quality.keep_good(docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others' `lang` is the recognised one."""
    return language.keep_known(docs, language.learn(docs.where(language.fold("doc_id", 5) != 0)))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` is replaced by its kind; `n_chars` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, each a sequence of its own."""
    return packing.pack(docs, registry.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good_quality),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
