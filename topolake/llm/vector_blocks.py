"""Vectors packed as blobs: index shards and query chunks, and the pairing of the two by number."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answers, materialize, usable, vector_classes, vector_keys

SHARD_ROWS = 4096
CHUNK_ROWS = 8192
PACKED = "part int, dim int, n int, cks binary, vecs binary, ids binary, counts binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ck")
    ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
    return pd.DataFrame({
        "part": [int(pdf["part"].iloc[0])], "dim": [int(pdf["dim"].iloc[0])], "n": [len(pdf)],
        "cks": [pdf["ck"].to_numpy(np.int64).tobytes()], "vecs": [np.stack(list(pdf["vec"])).astype("<f8").tobytes()],
        "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(x) for x in ids], np.int64).tobytes()],
    })


class Block:
    """An unpacked shard or chunk: class keys, vectors as doubles, and each class's smallest ids."""

    def __init__(self, cks: bytes, vecs: bytes, ids: bytes, counts: bytes, dim: int) -> None:
        self.cks = np.frombuffer(cks, np.int64)
        self.vecs = np.frombuffer(vecs, "<f8").reshape(-1, dim)
        self.ids = np.frombuffer(ids, np.int64)
        self.counts = np.frombuffer(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def expand(self, rows: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The `keep` best (id, score) of some classes, higher scores and then smaller ids first."""
        ids = np.concatenate([self.ids[self.starts[r] : self.starts[r] + self.counts[r]] for r in rows])
        each = np.repeat(scores, self.counts[rows])
        order = np.lexsort((ids, -each))[:keep]
        return ids[order], each[order]


def search(
    embeddings: DataFrame, rank: Callable[[Block, Block, int, np.ndarray], list], k: int, every: int, vec_id: str, vec: str,
    prepare: Callable, score_type: str, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS, carry: bool = False,
) -> DataFrame:
    """Each query's k best by rank(shard, chunk, keep, floors), which yields (query row, ids, scores) within one shard.

    Shards hold about shard_rows distinct vectors and chunks chunk_rows distinct queries, both chosen by a hash of the
    vector, so a task's memory is fixed at any table size. A chunk meets every shard; rows between tasks are blobs and
    the k + 1 best of each query and shard. With `carry`, every chunk meets the first shard alone at first, and goes to
    the others with each query's floor, the score that k + 1 candidates have reached: no shard starts from nothing.
    """
    rows = prepare(embeddings.where(usable(vec)).select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec")))
    rows = rows.where(F.col("vec_id").isNotNull())
    key = vector_keys(rows)
    classes = materialize(vector_classes(rows, key, k + 1, every).withColumn("dim", F.size("vec")), "vectors")
    n, asking = classes.agg(F.count("*"), F.count_if("asks")).first()
    shards, chunks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asking / chunk_rows))

    def packed(df: DataFrame, parts: int) -> DataFrame:
        keyed = df.withColumn("part", F.pmod(F.xxhash64("ck", F.lit(7)), F.lit(parts)).cast("int"))
        return keyed.groupBy("part", "dim").applyInPandas(_pack, PACKED)

    index = materialize(packed(classes, shards), "shards") if carry else packed(classes, shards)
    asked = packed(classes.where("asks"), chunks).select(
        F.col("part").alias("chunk"), "dim", F.col("cks").alias("q_cks"), F.col("vecs").alias("q_vecs"),
        F.col("ids").alias("q_ids"), F.col("counts").alias("q_counts"),
    )
    asked = materialize(asked, "chunks") if carry else asked

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                shard = Block(r.cks, r.vecs, r.ids, r.counts, r.dim)
                chunk = Block(r.q_cks, r.q_vecs, r.q_ids, r.q_counts, r.dim)
                floors = np.full(len(chunk.cks), -np.inf)
                if r.floors is not None:
                    floors[np.frombuffer(r.at, np.int64)] = np.frombuffer(r.floors, "<f8")
                cks, ids, scores = [], [], []
                for q, i, s in rank(shard, chunk, k + 1, floors):
                    cks.append(np.full(len(i), chunk.cks[q]))
                    ids.append(i)
                    scores.append(s)
                if cks:
                    yield pd.DataFrame({"ck": np.concatenate(cks), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    def floored(chunk: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        """A chunk's queries that have k + 1 scores, and the least of these, one step down where a double cannot hold it."""
        if chunk.empty or tops.empty:
            return pd.DataFrame({"chunk": [], "dim": [], "at": [], "floors": []})
        cks = np.frombuffer(chunk["q_cks"].iloc[0], np.int64)
        least = tops.groupby("ck")["score"].agg(["size", "min"])
        least = least[least["size"] > k]["min"]
        order = np.argsort(cks)
        at = order[np.searchsorted(cks, least.index.to_numpy(), sorter=order)].astype(np.int64)
        return pd.DataFrame({"chunk": [int(chunk["chunk"].iloc[0])], "dim": [int(chunk["dim"].iloc[0])], "at": [at.tobytes()], "floors": [floor_of(least.to_numpy()).tobytes()]})

    def met(shard: DataFrame, queries: DataFrame, pairs: int) -> DataFrame:
        # One pair of blobs is one unit of work; dealt singly so that no task holds many.
        each = shard.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return each.join(queries, ["chunk", "dim"]).repartition(max(1, pairs), "part", "chunk", "dim")

    none = [F.lit(None).cast("binary").alias(c) for c in ("at", "floors")]
    schema = f"ck long, vec_id long, score {score_type}"
    if carry and shards > 1:
        first = met(index.where("part = 0"), asked.select("*", *none), chunks).mapInPandas(run, schema)
        first = materialize(first, "first")
        homes = first.join(classes.where("asks").select("ck", "dim", F.pmod(F.xxhash64("ck", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk")), "ck")
        floors = asked.select("chunk", "dim", "q_cks").groupBy("chunk", "dim").cogroup(homes.groupBy("chunk", "dim")).applyInPandas(
            floored, "chunk int, dim int, at binary, floors binary")
        others = met(index.where("part > 0"), asked.join(floors, ["chunk", "dim"], "left"), (shards - 1) * chunks)
        tops = first.unionByName(others.mapInPandas(run, schema))
    else:
        tops = met(index, asked.select("*", *none), shards * chunks).mapInPandas(run, schema)
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", key.alias("ck"))
    return answers(tops, queries, k, score_type)


def floor_of(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles, none above what it stands for."""
    out = scores.astype(np.float64)
    return np.where(np.abs(out) < 2**53, out, np.nextafter(out, -np.inf))
