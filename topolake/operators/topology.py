"""Lineage, component and path operators on (nodes, edges) of any number of schema graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K

LINEAGE, FK = "derived_from", "fk_to"


def forward(edges: DataFrame) -> DataFrame:
    """(dataset, name, target): direct lineage targets."""
    return K.directed(edges, LINEAGE).select("dataset", F.col("src").alias("name"), F.col("dst").alias("target"))


def reverse(edges: DataFrame) -> DataFrame:
    """(dataset, name, source): direct lineage sources."""
    return K.directed(edges, LINEAGE).select("dataset", F.col("dst").alias("name"), F.col("src").alias("source"))


def closure(edges: DataFrame, upstream: bool = False, max_depth: int | None = None) -> DataFrame:
    """(dataset, seed, node, depth) of all lineage descendants or ancestors; never the start itself."""
    lineage = K.directed(edges, LINEAGE)
    lineage = K.flipped(lineage) if upstream else lineage
    seeds = lineage.select("dataset", F.col("src").alias("seed")).distinct()
    return K.reach(lineage, seeds, max_depth).where("depth > 0")


def transitive(edges: DataFrame) -> DataFrame:
    """(dataset, name, node) of descendants, for tables that have one beyond their direct targets."""
    found = closure(edges)
    far = found.groupBy("dataset", "seed").agg(F.max("depth").alias("deep")).where("deep > 1")
    return found.join(far, ["dataset", "seed"], "left_semi").select("dataset", F.col("seed").alias("name"), "node")


def combined_impact(edges: DataFrame, variant: str = "base") -> DataFrame:
    """(dataset, name, impacted): lineage descendants and what refers to them, by variant.

    base: also children of the table itself, one hop, given if a child adds to the lineage. extended: the same without
    the table's own children. both_ways: one hop along references in either direction, the table's own among them,
    given from three on. full_search: references in either direction to any depth, from the descendants.
    """
    lineage = closure(edges).select("dataset", "seed", "node")
    fk = K.directed(edges, FK)
    hop = fk.select("dataset", F.col("dst").alias("node"), F.col("src").alias("hit"))
    if variant in ("both_ways", "full_search"):
        hop = K.undirected(edges, FK).select("dataset", F.col("src").alias("node"), F.col("dst").alias("hit"))
    if variant == "full_search":
        walk = K.reach(hop.select("dataset", F.col("node").alias("src"), F.col("hit").alias("dst")), lineage.select("dataset", F.col("node").alias("seed")))
        hit = lineage.join(walk.select("dataset", F.col("seed").alias("node"), F.col("node").alias("hit")), ["dataset", "node"])
    else:
        own = lineage.select("dataset", "seed", F.col("seed").alias("node")).distinct()
        hit = (lineage if variant == "extended" else lineage.unionByName(own)).join(hop, ["dataset", "node"])
    hit = hit.select("dataset", "seed", F.col("hit").alias("node")).where("node <> seed").distinct()
    if variant in ("base", "extended"):
        hit = hit.join(lineage, ["dataset", "seed", "node"], "left_anti")
    both = lineage.withColumn("extra", F.lit(0)).unionByName(hit.withColumn("extra", F.lit(1)))
    found = both.groupBy("dataset", F.col("seed").alias("name")).agg(F.array_sort(F.collect_set("node")).alias("impacted"), F.sum("extra").alias("extra"))
    keep = {"base": F.col("extra") > 0, "extended": F.col("extra") > 0, "both_ways": F.size("impacted") >= 3, "full_search": F.lit(True)}
    return found.where(keep[variant]).select("dataset", "name", "impacted")


def multi_source(edges: DataFrame, least: int = 3) -> DataFrame:
    """(dataset, name, sources, n_sources) of tables with at least so many direct sources."""
    found = reverse(edges).groupBy("dataset", "name").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.countDistinct("source").alias("n_sources"))
    return found.where(F.col("n_sources") >= least)


def silos(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, comp, silo): components numbered from 0 in order of their first table."""
    w = Window.partitionBy("dataset").orderBy("comp")
    return K.components(nodes, edges).withColumn("silo", (F.dense_rank().over(w) - 1).cast("int"))


def membership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, other) of the other tables of each table's component."""
    comp = K.components(nodes, edges)
    other = comp.select("dataset", "comp", F.col("name").alias("other"))
    return comp.join(other, ["dataset", "comp"]).where("name <> other").select("dataset", "name", "other")


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, a, b, is_connected, is_isolated) for pairs a < b of one catalogue."""
    comp = K.components(nodes, edges)
    a, b = (comp.select("dataset", F.col("name").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    return a.join(b, "dataset").where("a < b").select("dataset", "a", "b", (F.col("ca") == F.col("cb")).alias("is_connected"), (F.col("ca") != F.col("cb")).alias("is_isolated"))


def _all_pairs(nodes: DataFrame, seeds: Column | None = None) -> DataFrame:
    s = nodes.select("dataset", F.col("name").alias("s"))
    return s.join(nodes.select("dataset", F.col("name").alias("t")), "dataset")


def join_paths(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """(dataset, s, t, path) for all pairs: the least shortest path by names, [] if there is none, [s] from s to s."""
    both = K.undirected(edges, *kinds).join(nodes.select("dataset").distinct(), "dataset", "left_semi")
    found = K.reach(both, nodes.select("dataset", F.col("name").alias("seed")), paths=True)
    found = found.select("dataset", F.col("seed").alias("s"), F.col("node").alias("t"), "path")
    return _all_pairs(nodes).join(found, ["dataset", "s", "t"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def hop_counts(nodes: DataFrame, edges: DataFrame, *kinds: str, seeds: Column | None = None) -> DataFrame:
    """(dataset, s, t, hops) for all pairs, -1 where there is no path; seeds limits the starts that are searched."""
    starts = nodes.select("dataset", F.col("name").alias("seed"))
    starts = starts.where(seeds) if seeds is not None else starts
    found = K.reach(K.undirected(edges, *kinds), starts).select("dataset", F.col("seed").alias("s"), F.col("node").alias("t"), F.col("depth").alias("hops"))
    return _all_pairs(nodes).join(found, ["dataset", "s", "t"], "left").withColumn("hops", F.coalesce("hops", F.lit(-1)))


def direct(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, s, t, is_direct) for ordered pairs: whether s refers to t."""
    fk = K.directed(edges, FK).select("dataset", F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(True).alias("hit"))
    return _all_pairs(nodes).where("s <> t").join(fk, ["dataset", "s", "t"], "left").select("dataset", "s", "t", F.coalesce("hit", F.lit(False)).alias("is_direct"))


def dim_pairs(dim: DataFrame, edges: DataFrame) -> DataFrame:
    """(silo, via, s, t): pairs of a silo's dimensions and the first fact table that refers to both."""
    fk = K.directed(edges, FK).join(dim.select("silo", F.col("name").alias("src"), F.col("ordinal").alias("rank")), "src")
    place = dim.select(F.col("name").alias("dst"), "ordinal")
    fk = fk.join(place, "dst").select("silo", "src", "rank", "dst", "ordinal")
    a = fk.select("silo", "src", "rank", F.col("dst").alias("s"), F.col("ordinal").alias("oa"))
    b = fk.select("silo", "src", F.col("dst").alias("t"), F.col("ordinal").alias("ob"))
    both = a.join(b, ["silo", "src"]).where("oa < ob")
    return both.groupBy("silo", "s", "t").agg(F.min_by("src", "rank").alias("via")).select("silo", "via", "s", "t")


def fact_paths(dim: DataFrame, edges: DataFrame) -> DataFrame:
    """(silo, s, t, path): each fact table, each dimension that it refers to, and the one hop between."""
    fk = K.directed(edges, FK)
    facts = dim.where(F.col("name").startswith("fact")).select("silo", F.col("name").alias("src"))
    dims = dim.where(F.col("name").startswith("dim")).select(F.col("name").alias("dst"))
    return fk.join(facts, "src").join(dims, "dst").select("silo", F.col("src").alias("s"), F.col("dst").alias("t"), F.array("src", "dst").alias("path"))


def neighbours(nodes: DataFrame, edges: DataFrame, hops: int, *kinds: str) -> DataFrame:
    """(dataset, seed, node, depth) within so many hops, the start left out."""
    return K.reach(K.undirected(edges, *kinds), nodes.select("dataset", F.col("name").alias("seed")), hops).where("depth > 0")


def valid_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_valid) for (id, path): every hop is a reference in one direction or the other."""
    hops = paths.select("id", F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path))").alias("b"))).alias("h")).where("h.a IS NOT NULL AND h.b IS NOT NULL")
    both = K.undirected(edges, FK).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    hit = hops.select("id", "h.a", "h.b").join(both, ["a", "b"]).groupBy("id").agg(F.count("*").alias("n"))
    return paths.join(hit, "id", "left").select("id", (F.coalesce("n", F.lit(0)) == F.size("path") - 1).alias("is_valid"))
