"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents with all their columns; the last returns pieces of packed
sequences. Stages judge their own input only. No SQL expresses the learned first stage, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm import exact_dedup, jaccard_join, mixing, packing, quality_classifier
from ledgermill.llm.common import save
from ledgermill.llm.queries import tokenizer_path

#: How even the mix's source shares are (of the greatest entropy), as far as this share of the tokens can still be kept.
ENTROPY, LEAST = 0.95, 0.5


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share four fifths of their 5-word shingles."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a tempered mix of sources that repeats none; all of them where the sources are even enough."""
    return mixing.sample_once(docs, entropy=ENTROPY, least=LEAST)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_classifier", drop_poor),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
