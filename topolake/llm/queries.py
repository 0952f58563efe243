"""The queries opN_<name>: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, dialogues, divergence, htmltext, langid, mixing, neardup, ngram_lm, packing, repeats, secrets, topk, toxicity
from .common import fold, table
from .sql import ORACLE, PARTS
from .sql_more import MORE


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it stays, for every document."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte repeats of documents of smaller id take from every document."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secrets of every document as counts, spans and a digest; a null text is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs).drop("text")
    count = lambda kind: F.size(F.filter("base_", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base_")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets_")).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fifth; empty texts score as clean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 0))
    weights, logistic = toxicity.fit(toxicity.labelled(docs, labels))
    rated = toxicity.score(docs, weights, logistic)
    return rated.select(
        "doc_id", fold("doc_id", 5, 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "n_toxic_hits",
    )


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every query vector by cosine."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer_path(), special=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 4, 2)).select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), train)
    return found.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt outside the held-out fifth."""
    held = fold("doc_id", 5, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held & F.col("doc_id").isNotNull()).alias("train"))
    found = ngram_lm.score_texts(docs, "train")
    return found.select("doc_id", fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer inner products of every query vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a labeller learnt from the table's own plain markup and from made pages."""
    pages = table(spark, sf_dir, "pages")
    found = htmltext.extract(pages.select("page_id", "url", "html"), htmltext.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest edits and a digest of what they leave."""
    return dialogues.repair(table(spark, sf_dir, "conversations"))


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 mixes from each source, as SQL can state it: its size and target."""
    placed = mixing.mix(table(spark, sf_dir, "documents"))[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").distinct()
    found = placed.join(docs, "doc_id").groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    return found.select("source", "source_size", F.round("target", 6).alias("target"))


def lm_base_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base model with every document to learn from, as SQL can state it."""
    found = ngram_lm.score_texts(table(spark, sf_dir, "documents").withColumn("train", F.lit(True)), "train")
    return found.select("doc_id", "n_tokens", "train_tokens", F.round("base_score", 5).alias("base_score"))


def queries() -> dict:
    ops = (op1_near_duplicates, op2_repeat_removal, op3_source_mixing, op4_secret_scans, op5_toxicity, op6_nearest_neighbours, op7_best_fit_packing, op8_language_id, op9_lm_scoring, op10_exact_top_k, op11_html_extraction, op12_source_divergence, op13_conversation_repair)
    return {f.__name__: f for f in (*ops, mix_source_targets, lm_base_of_all)}


def oracle_sql() -> dict[str, str]:
    return ORACLE | PARTS | MORE
