"""Inputs that already have columns of the operators' names."""

from pathlib import Path

import pytest
from helpers import documents
from pyspark.sql import functions as F

from layerkv.llm import chat, decontamination, html_text, mixing, near_dedup, quality_model, quality_rules, secrets, sharding, toxicity
from layerkv.llm.mixing import word_count

NAMES = "score kept size target shard slot spans n_words _source _n _part copies base_failed text_crc32 class_id start edits keys hi a.b _words _sum _total byte_start".split()


@pytest.fixture
def docs(spark):
    rows = documents(spark, [(k, f"some words of text number {k} " * 8, "ab"[k % 2]) for k in range(6)])
    return rows.select("*", *[F.lit(f"in {n}").alias(n) for n in NAMES])


def test_every_operator_takes_them(spark, docs):
    empty = quality_model.fit([], (0, 0))
    assert quality_model.score(docs, empty).where("score > 0.99").count() == 6
    assert quality_model.keep_good(docs, empty, 0.3).columns == docs.columns
    assert toxicity.score(docs, toxicity.fit([], (0, 0))).where("score < 0.5").count() == 6
    rules = quality_rules.measure(docs, [0.0] * quality_rules.BUCKETS)
    assert rules.where("n_words = 48 AND kept IS NOT NULL").count() == 6 and rules.columns.count("kept") == 1
    if Path(secrets.VOCABULARY).exists():
        assert secrets.scan(docs).where("spans = '' AND score = 'in score'").count() == 6
    pages = docs.select(F.concat(F.lit("<p>"), "text").alias("html"), "text", "n_chars", "score")
    assert html_text.extract(pages).where("text LIKE 'some words%' AND score = 'in score'").count() == 6
    out = sharding.assign_shards(docs, sharding.text_bytes(), {"doc_id": F.col("doc_id")}, 2, keep=tuple(docs.columns))
    assert out.where("slot >= 0 AND score = 'in score'").count() == 6
    assert mixing.plan_mix(docs, word_count(F.col("text"))).where("size = 48 AND score = 'in score'").count() == 6
    assert mixing.mix(docs).columns == docs.columns
    assert near_dedup.classes(docs).columns == ["doc_id", "class_id"] and near_dedup.keep_first(docs).columns == docs.columns
    items = spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    assert decontamination.findings(docs, items).count() == 0 and decontamination.drop_contaminated(docs, items).columns == docs.columns
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), "text", "start", "score", F.lit(0).alias("assistant"))
    assert chat.perspectives(turns).count() == 12
