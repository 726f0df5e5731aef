"""Many rows of one key or none, columns of any name, texts beyond a budget, words without end."""

import numpy as np
import pytest
from ledgermill.llm import exact_dedup, jaccard_join, language_id, language_model, mixing, packing, quality_classifier
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def unnamed(spark):
    """600 rows without doc_id and 200 of one doc_id, all of different texts."""
    return spark.range(800).select(F.when(F.col("id") < 200, 7).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") * k).cast("string")) for k, w in enumerate(("the", "water", "stone", "house", "und", "so"), 1)]).alias("text"), F.lit("s").alias("source"))


def largest(blocks):
    return max(r["count"] for r in blocks.groupBy("block").count().collect())


def test_rows_without_ids_are_dealt_by_their_texts(unnamed, monkeypatch):
    monkeypatch.setattr(language_model.Plan, "__init__", lambda self, docs: self.__dict__.update(blocks=16, deleted_blocks=4))
    assert largest(language_model._dealt(unnamed, language_model.Plan(unnamed), F.lit(0))) < 200


def test_rows_without_ids_share_no_block_or_group(unnamed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MB", 0.002)
    assert jaccard_join.join(unnamed, 1, 90).count() == 800
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 50)
    used = mixing.mix(unnamed, 1.0, 0.0, 1.0)
    assert used.count() == 800 and max(r["count"] for r in used.filter("doc_id IS NULL").groupBy("block").count().collect()) < 200


def test_groups_of_packing_by_text(unnamed):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = packing.pack(unnamed, public_tokenizers.path("word_bpe_49k.json"), 1, 64, group_mb=0.002)
    groups = got.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count_if(F.col("start") == 0).alias("n")).collect()
    assert sum(r["n"] for r in groups) == 800 and max(r["n"] for r in groups) < 200


def test_stretches_give_the_same_offsets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    rows = lambda: sorted((tuple(map(str, r)) for r in mixing.mix(docs, 1.0, 0.9, 2.0).filter("doc_id IS NOT NULL").collect()))
    many = rows()
    monkeypatch.setattr(mixing, "STRETCH", 0)
    assert rows() == many and len(many) > 100


def test_a_text_over_the_budget_is_passed_over(spark, texts, monkeypatch):
    assert quality_classifier.fitting([(1, 1, 50), (2, 0, 30), (3, 1, 80), (4, 0, 20)], 60) == [(1, 1)]
    assert quality_classifier.fitting([(1, 1, 61), (2, 0, 30), (3, 1, 30), (4, 0, 1)], 60) == [(2, 0), (3, 1)]
    good = [(i, t) for i, t, *_ in texts if i < 100]
    junk = [(1000 + i, "BUY $$$ ### " * 30) for i in range(60)]
    long = [(5000 + i, "water stone " * 20_000) for i in range(5)]
    docs = spark.createDataFrame(good + junk + long, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good + long] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    monkeypatch.setattr(quality_classifier, "SAMPLE_MB", 0.2)  # each long text is larger
    out = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, labels).collect()}
    assert not any(out[i] for i, _ in junk) and np.mean([out[i] for i, _ in good]) > 0.9


def test_columns_of_any_name_stay(docs):
    clashing = docs.withColumn("digest", F.lit("mine")).withColumn("digest_", F.lit(3)).withColumn("gone_id", F.lit(4)).withColumn("gone_digest", F.lit(5)).withColumn("Digest__", F.lit(6))
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert {(r["digest"], r["digest_"], r["gone_id"], r["gone_digest"], r["Digest__"]) for r in kept.collect()} == {("mine", 3, 4, 5, 6)}


def test_words_without_end_are_learned(spark):
    """Scripts without spaces: one run of letters a text."""
    rng = np.random.default_rng(2)
    draw = lambda letters: "".join(rng.choice(list(letters), 300))
    rows = [(i, draw("あいうえおかき") if i % 2 else draw("กขคงจฉช"), "ja" if i % 2 else "th") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs).collect()}
    assert all(out[i] == lang for i, _, lang in rows)
