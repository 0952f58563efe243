"""Exact top-k inner products over integer vectors with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Block, floor_of, search

BLOCK_ROWS = 32


def _arranged(vecs: np.ndarray, size: int) -> np.ndarray:
    """An order that puts like vectors into one block: halves by the widest coordinate, again and again."""
    parts = [np.arange(len(vecs))]
    while max(map(len, parts)) > size:
        halves = []
        for p in parts:
            if len(p) <= size:
                halves.append(p)
                continue
            axis = int(np.argmax(vecs[p].var(0)))
            order = p[np.argsort(vecs[p, axis], kind="stable")]
            cut = (len(p) // 2 + size - 1) // size * size
            halves += [order[:cut], order[cut:]]
        parts = [p for p in halves if len(p)]
    return np.concatenate(parts)


def _products(docs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while sums stay below 2**53, Python integers beyond, held within a long."""
    if np.abs(docs).max() * np.abs(query).max() * docs.shape[1] < 2**53:
        return docs @ query.T
    whole = docs.astype(object) if docs.dtype != object else docs
    exact = np.array([[int(x) for x in row] for row in whole], object) @ np.array([[int(x) for x in row] for row in query], object).T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, x)), otypes=[object])(exact)


def exact_top_k(
    embeddings: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vec: str = "embedding",
    scale: int = 256, block_rows: int = BLOCK_ROWS, **sizes: int,
) -> DataFrame:
    """The k largest integer inner products of floor(scale * x) vectors for each row whose id is divisible by `every`.

    A shard's vectors lie in ranges of `block_rows` with like vectors together; each range keeps every term's largest
    and smallest value. A query's bound for a range is the sum over terms of the larger of its value times either;
    ranges are scored through their forward vectors in falling bound order, more at each step, until the bound is below
    the k-th score, ties included, so the result is exact. The k-th score of a first shard is carried to all others.

    Defined cases: null, empty or non-finite vectors and null ids take no part; vectors of another dimension are never
    compared; scores beyond a long are held at its ends; ties go to the smaller id; of rows that repeat a
    query's id, one is its own; an empty table gives no rows.
    """

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("double")))

    def rank(shard: Block, chunk: Block, keep: int, floors: np.ndarray) -> list:
        out = []
        for q, rows, score, _ in ranked(shard.vecs, chunk.vecs, keep, floors, block_rows):
            ids, score = shard.expand(rows, score, keep)
            out.append((q, ids, np.array([int(x) for x in score], np.int64)))
        return out

    return search(embeddings, rank, k, every, vec_id, vec, prepare, "long", carry=True, **sizes)


def ranked(vecs: np.ndarray, queries: np.ndarray, keep: int, floors: np.ndarray, block_rows: int = BLOCK_ROWS):
    """(query, rows, scores, ranges scored) of each query's rows that can be among its `keep` best and reach its floor."""
    order = _arranged(vecs, block_rows)
    docs, n = vecs[order], len(order)
    starts = np.arange(0, n, block_rows)
    high, low = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    for q0 in range(0, len(queries), 256):
        qs = queries[q0 : q0 + 256]
        bound = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
        bound += np.abs(bound) * 1e-12  # sums beyond 2**53 are rounded
        turn, kth, m = np.argsort(-bound, axis=1, kind="stable"), floors[q0 : q0 + 256].copy(), len(qs)
        rows, scores, done = [[] for _ in range(m)], [[] for _ in range(m)], np.zeros(m, np.int64)
        at, step = 0, 4
        while at < len(starts):
            blocks = turn[:, at : at + step]
            who, col = np.nonzero(np.take_along_axis(bound, blocks, 1) >= kth[:, None])
            if not len(who):
                break
            which = blocks[who, col]
            by = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.append(True, which[by][1:] != which[by][:-1]))
            for i, j in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                b, asking = int(which[by[i]]), who[by[i:j]]
                span = np.arange(starts[b], min(starts[b] + block_rows, n))
                got = _products(docs[span], qs[asking])
                good = got >= kth[asking]
                done[asking] += 1
                for c in np.flatnonzero(good.any(0)).tolist():
                    rows[asking[c]].append(span[good[:, c]])
                    scores[asking[c]].append(got[good[:, c], c])
            for q in np.unique(who).tolist():
                if rows[q]:
                    own, score = np.concatenate(rows[q]), np.concatenate(scores[q])
                    if len(own) >= keep:
                        least = np.sort(score)[-keep]
                        own, score = own[score >= least], score[score >= least]
                        kth[q] = max(kth[q], floor_of(np.array([least]))[0])
                    rows[q], scores[q] = [own], [score]
            at, step = at + step, 4 * step
        for q in range(m):
            if rows[q]:
                yield q0 + q, order[rows[q][0]], scores[q][0], int(done[q])
