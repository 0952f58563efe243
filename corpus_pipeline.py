"""A training corpus from raw documents: toxic ones out, one of each group of near copies, secrets blanked, sources mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.llm import mixing, neardup, packing, secrets, toxicity
from topolake.llm.common import fold, materialize, table, unwrapped, wrapped

# SQL cannot express a fitted score, a seeded draw or a tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half, by a model of the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 0))
    weights, logistic = toxicity.fit(toxicity.labelled(docs, labels))
    return unwrapped(toxicity.score(wrapped(docs, "text"), weights, logistic).where("toxicity < 0.5"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, of its smallest id."""
    return neardup.without_copies(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by [SECRET]."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the weighted mix takes, as documents once an epoch."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents, each result but the last written in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
