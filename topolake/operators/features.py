"""Structural features of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K


def degrees(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """(dataset, name, in_deg, out_deg, degree_c) on distinct edges; degree_c = (in + out) / (n - 1)."""
    one = K.directed(edges, *kinds)
    into = one.groupBy("dataset", F.col("dst").alias("name")).agg(F.count("*").alias("in_deg"))
    out = one.groupBy("dataset", F.col("src").alias("name")).agg(F.count("*").alias("out_deg"))
    zero = F.lit(0).cast("bigint")
    total = nodes.groupBy("dataset").agg(F.count("*").alias("n"))
    both = nodes.select("dataset", "name").join(total, "dataset").join(into, ["dataset", "name"], "left").join(out, ["dataset", "name"], "left")
    both = both.withColumns({"in_deg": F.coalesce("in_deg", zero), "out_deg": F.coalesce("out_deg", zero)})
    return both.select("dataset", "name", "in_deg", "out_deg", ((F.col("in_deg") + F.col("out_deg")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_c"))


def approximated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, out_deg, in_deg, norm, lineage_deg, betweenness, rank) from degrees with repeats alone.

    norm = degree / largest one-way degree, betweenness = norm / 2, rank = (in + 1) / (edges + tables).
    """
    n = lambda kind, end, name: edges.where(F.col("edge_type") == kind).groupBy("dataset", F.col(end).alias("name")).agg(F.count("*").alias(name))
    rows = nodes.select("dataset", "name")
    for kind, end, name in (("fk_to", "src", "out_deg"), ("fk_to", "dst", "in_deg"), ("derived_from", "src", "lo"), ("derived_from", "dst", "li")):
        rows = rows.join(n(kind, end, name), ["dataset", "name"], "left")
    rows = rows.fillna(0, ["out_deg", "in_deg", "lo", "li"])
    total = rows.groupBy("dataset").agg(F.greatest(F.max("out_deg"), F.max("in_deg"), F.lit(1)).alias("most"), F.count("*").alias("n"), F.sum(F.col("out_deg") + F.col("lo")).alias("e"))
    rows = rows.join(total, "dataset")
    norm = (F.col("out_deg") + F.col("in_deg")) / F.col("most")
    return rows.select("dataset", "name", "out_deg", "in_deg", norm.alias("norm"), (F.col("lo") + F.col("li")).alias("lineage_deg"), (norm / 2).alias("betweenness"), ((F.col("in_deg") + 1) / (F.col("e") + F.col("n"))).alias("rank"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(dataset, position, name, degree): the k tables of most references, ties by name."""
    w = Window.partitionBy("dataset").orderBy(F.desc("degree"), "name")
    found = degrees(nodes, edges, "fk_to").select("dataset", "name", (F.col("in_deg") + F.col("out_deg")).alias("degree"))
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("dataset", "position", "name", "degree")
