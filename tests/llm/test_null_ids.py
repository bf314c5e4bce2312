"""Rows without an id, everywhere."""

import pytest
from pyspark.sql import functions as F

from quarrysift.llm import chat_format, exact_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, tokens, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
from quarrysift.llm._common import labelled_sample

TEXT = "one two three four five six seven"


@pytest.fixture(scope="module")
def docs(frame):
    return frame([(None, TEXT), (None, None), (None, TEXT + " !"), (4, TEXT + " !"), (5, TEXT), (None, "quite another text with words of its own")])


def test_dedup(docs):
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()))
    assert got == sorted([(0, 5, 2, False), (0, 0, 1, True), (0, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (0, 0, 1, True)])
    assert exact_dedup.drop_copies(docs).count() == 4
    near = near_dedup.near_dedup(docs).collect()
    assert len(near) == 6 and all(r.kept for r in near if r.component_id is None)
    assert near_dedup.drop_near_copies(docs).where("doc_id IS NULL").count() == 4


def test_others(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.best_fit_pack(tokens.tokenize_pieces(docs, path)).count() == 6
    assert mixing.mix_sources(docs).count() == 6 and quality_rules.quality_rules(docs).count() == 6
    assert token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 6
    labels = spark.createDataFrame([(None, 1, 0), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert sample.count() == 2 and toxicity.score(docs, toxicity.train(sample)).count() == 6
    assert quality_classifier.score(docs, quality_classifier.train(labelled_sample(docs, labels, "quality", F.lit(True), 10))).count() == 6
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/").alias("url"))
    assert url_filter.url_filter(pages, url_filter.DEFAULT_RULES).count() == 6
    assert chat_format.format_chat(docs.select(F.col("doc_id").alias("conv_id"), "lang", "text", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"))).count() == 3
