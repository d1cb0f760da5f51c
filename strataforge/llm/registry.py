"""Queries of the numbered operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, katz, language, neardup, oracle, packing, pii, quality, tiff, toxicity, unigram, variants, wavelet
from ._spark import new_path, read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a one-page TIFF, read back: checksums of payload and file, and a feature of the page. A row per document."""
    return tiff.text_media_digest(read(spark, sf_dir, "documents"))


def op2_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text by rank; ids as a checksum, and whether they decode to the text."""
    return unigram.encode_n_best(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op3_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near-duplicates, named by the smallest id, and the class's size."""
    return neardup.classes(read(spark, sf_dir, "documents"))


def op4_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of every document, by models of all documents."""
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, each a sequence of its own."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, learned from those outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    samples = language.learn(docs.where(language.fold("doc_id", 5) != 0))
    held_out = (language.fold("doc_id", 5) == 0).alias("held_out")
    return language.identify(docs, samples).select("doc_id", held_out, "lang_pred", "score", "letters", "bits")


def op7_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of every document."""
    return pii.find(read(spark, sf_dir, "documents"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document, learned from those outside the held-out tenth."""
    return katz.score_texts(read(spark, sf_dir, "documents"))


def op9_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out quarter."""
    labels = read(spark, sf_dir, "labels").where(language.fold("doc_id", 4) != 2).select("doc_id", "toxic")
    found = toxicity.score(read(spark, sf_dir, "documents"), labels)
    return found.withColumn("held_out", language.fold("doc_id", 4) == 2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and score of the best segmentation of every document."""
    return unigram.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the texts, some occurrences damaged, with its form, its root and its number of near words."""
    return variants.group_variants(variants.vocabulary(read(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: its faults, the cheapest edits that repair it, and the repaired rows' checksum."""
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op13_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts' ids written to wavelet matrix files and read back: each document's place, number of ids and their checksum."""
    docs, path = read(spark, sf_dir, "documents"), new_path(spark, "wavelet")
    wavelet.write_shards(docs, path, tokenizer("word_bpe_49k.json"))
    return wavelet.document_digests(wavelet.read_shards(spark, path), docs.schema["doc_id"].dataType).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_tiff_pages, op2_nbest_segmentation, op3_probminhash_dedup, op4_perplexity_bands, op5_power_of_two_packing, op6_language_id, op7_pii_candidates, op8_katz_backoff, op9_toxicity_lexicon, op10_token_counts, op11_spelling_variants, op12_conversation_repair, op13_wavelet_shards)}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
