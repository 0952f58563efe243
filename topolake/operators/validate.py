"""Checks as DataFrames: a row a finding, none where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K


def graph_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, finding, subject): ends outside the tables, loops, repeated edges, references opposed by a derivation."""
    known = nodes.select("dataset", "name")
    lost = lambda end: edges.join(known.withColumnRenamed("name", end), ["dataset", end], "left_anti").select("dataset", F.lit(f"unknown {end}").alias("finding"), F.concat_ws(">", "src", "dst").alias("subject"))
    loops = edges.where("src = dst").select("dataset", F.lit("loop").alias("finding"), F.col("src").alias("subject"))
    again = edges.groupBy("dataset", "src", "dst", "edge_type").count().where("count > 1").select("dataset", F.lit("repeated").alias("finding"), F.concat_ws(">", "src", "dst").alias("subject"))
    back = K.flipped(K.directed(edges, "derived_from"))
    opposed = K.directed(edges, "fk_to").join(back, ["dataset", "src", "dst"], "left_semi").select("dataset", F.lit("opposed").alias("finding"), F.concat_ws(">", "src", "dst").alias("subject"))
    return lost("src").union(lost("dst")).union(loops).union(again).union(opposed)


def closure_differences(edges: DataFrame, others: DataFrame) -> DataFrame:
    """(dataset, n_pairs, n_differing): what the ends of edges reach downstream, against what others reach upstream.

    b is downstream of a just where a is upstream of b; over the same edges no pair is in one closure only.
    """
    walk = lambda e: K.reach(e, e.select("dataset", F.col("src").alias("seed")).distinct()).where("depth > 0")
    down = walk(edges).select("dataset", F.col("seed").alias("a"), F.col("node").alias("b"), F.lit(1).alias("d"))
    up = walk(K.flipped(others)).select("dataset", F.col("node").alias("a"), F.col("seed").alias("b"), F.lit(1).alias("u"))
    both = down.join(up, ["dataset", "a", "b"], "full").where("a <> b")
    return both.groupBy("dataset").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("d").isNull() | F.col("u").isNull()).alias("n_differing"))


def count_findings(counts: DataFrame, official: DataFrame) -> DataFrame:
    """(dataset, what, n, official) where a count differs from the official one."""
    return counts.join(official, ["dataset", "what"]).where("n <> official")


def question_findings(questions: DataFrame) -> DataFrame:
    """(id, finding): missing fields, unknown answer types, repeated texts."""
    kinds = ("list", "ordered_list", "integer", "boolean", "string", "number")
    flags = F.array_compact(F.array(
        F.when(F.col("question").isNull() | (F.trim("question") == ""), "no text"), F.when(~F.coalesce(F.col("answer_type").isin(*kinds), F.lit(False)), "unknown answer type"), F.when(F.col("answer").isNull(), "no answer")))
    own = questions.select("id", F.explode(flags).alias("finding"))
    twice = questions.groupBy("question").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("question", "first")
    return own.union(questions.join(twice, "question").where("id <> first").select("id", F.lit("repeated text").alias("finding")))


def integrity(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(baseline, dataset, n, n_ids, expected, verdict) of result sets."""
    got = results.groupBy("baseline", "dataset").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))
    verdict = F.when(F.col("n") != F.col("n_ids"), "repeated ids").when(F.col("n") != F.col("expected"), "wrong count").otherwise("ok")
    return got.join(expected, "dataset").withColumn("verdict", verdict)
