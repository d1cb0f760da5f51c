"""The pipeline's stages, and the registered queries over the smallest tables."""

import random

import corpus_pipeline
import pytest
from strataforge.llm import registry


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == before


OF_OTHER_ROWS = ("op11_spelling_variants", "op12_conversation_repair")  # words and conversations


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(OF_OTHER_ROWS)))
def test_queries_return_a_row_for_each_document(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, mark string, row string, found string, bands string"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, *["x"] * 5)] * 3, [(1, "", "", "", 0, *["x"] * 5), (2, "one two", None, "s", 7, *["x"] * 5)]])
def test_stages_on_odd_tables(spark, rows):
    """Empty tables, null rows, repeated ones, and columns named like those inside the operators."""
    docs = spark.createDataFrame(rows, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)


def test_many_languages_and_odd_names(spark):
    """More languages than have models that all texts use, with columns named like the inner ones and a name with a backtick."""
    words = "stone river walks under green light and slowly finds the old mill beside a field of barley".split()
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=40))
    names = ["doc_id", "text", "lang", "source", "n_chars", "own_", "slice_", "grams_", "limits_", "a`b", "row_", "hash_"]
    docs = spark.createDataFrame([(i, text(i), f"l{i % 40}", "s", 0, *["x"] * 7) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names[5:]))
    assert docs.columns == names
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 100 and docs.where("own_ <> 'x'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 100


def test_clean_text_goes_through(spark):
    words = "stone river walks under green light and slowly finds the old mill beside a field of barley".split()
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=60))
    with_mail = lambda i: f"mail to jo@mill{i}.org {text(i)}" if i % 3 == 0 else text(i)
    rows = [(i, with_mail(i), "en", "s", 0, *["x"] * 5) for i in range(60)] + [(100, text(1), "en", "s", 0, *["x"] * 5)]
    docs = spark.createDataFrame(rows, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), ODD)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(range(60)) and all(r.mark == "x" and r.n_chars == len(r.text) for r in got.values())
    assert all(("[EMAIL]" in r.text) == (i % 3 == 0) and "@" not in r.text for i, r in got.items())
