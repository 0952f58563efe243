"""Registered queries: against SQL where there is some, else their shape; and the pipeline by stages."""

import os

import pytest
from pyspark.sql import functions as F

from topolake.llm.queries import oracle_sql, queries

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(queries()[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLE)))
def test_query_covers_its_table(name, spark, sf_dir):
    found = queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct().count()
    if "doc_id" in found.columns:
        assert found.select("doc_id").distinct().count() == docs
    else:
        assert found.count() > 0


def test_held_out_toxicity_is_caught_in_each_language(spark):
    larger = "/root/testdata/sf0.1"
    if not os.path.isdir(larger):
        pytest.skip(f"{larger} is not there")
    labels = spark.read.parquet(f"{larger}/labels.parquet").join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id")
    found = queries()["op5_toxicity"](spark, larger).where("held_out").join(labels, "doc_id").groupBy("lang", "toxic").agg(F.avg("predicted"), F.count("*")).collect()
    assert len(found) >= 8
    for lang, toxic, caught, n in found:
        assert caught >= 0.9 if toxic else caught <= 0.02, (lang, toxic, caught, n)


def test_held_out_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = queries()["op8_language_id"](spark, sf_dir).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count() > 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == names
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == sizes["packing"]


def test_pipeline_takes_odd_and_empty_documents(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (docs is odd_docs)
