"""Connected components of an edge table by alternating stars, written out every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

MAX_ROUNDS, FILE_EDGES = 60, 250_000


def components(edges: DataFrame, tag: str = "components", first_files: int | None = None) -> DataFrame:
    """(node, root) for all nodes on edges (a, b): root is the component's smallest node.

    Each round hangs a node's larger neighbours on its smallest (large star), then its smaller ones (small star), and
    drops repeated edges. Both are group minima, combined before the shuffle, and a join that adaptive execution splits
    where one node is hot; a component is never one task's. Rounds grow with the logarithm of a component's diameter.
    Edges are never collected; loops and repeats are harmless; no edges give no rows.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(start.coalesce(first_files) if first_files else start, tag)
    # A file for each so many edges: rounds on few edges would otherwise spend their time on opening empty files.
    files = max(1, -(-now.count() // FILE_EDGES))
    for _ in range(MAX_ROUNDS):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(files), tag)
        # A star forest in which no root is also a leaf is final.
        moving = new.select(F.col("b").alias("a")).distinct().join(new.select("a").distinct(), "a", "left_semi")
        stars = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        done = moving.limit(1).count() == 0 and stars.limit(1).count() == 0
        drop(now)
        now = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
