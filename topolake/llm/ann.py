"""Approximate nearest neighbours: multiprobe p-stable hashing over shards, exact cosine reranking."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Block, search

TABLES, PROJECTIONS, WIDTH, PROBES, SEED = 12, 4, 1.0, 30, 20


def probe_order(frac: np.ndarray, probes: int) -> np.ndarray:
    """Perturbations in {-1,0,1}^m for each row of offsets within a bucket, likeliest first.

    The estimated chance that a neighbour lies in a perturbed bucket falls with the summed squared distance from the
    query to that bucket's near walls.
    """
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=frac.shape[1])), np.int64)
    far = (steps == -1)[None] * (frac**2)[:, None, :] + (steps == 1)[None] * ((1 - frac) ** 2)[:, None, :]
    order = np.argsort(far.sum(2), axis=1, kind="stable")[:, :probes]
    return steps[order]


def _numbers(cells: np.ndarray) -> np.ndarray:
    """One integer a bucket; cells are small integers, so 16 bits a coordinate hold them."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        out = out * 65599 + cells[..., j]
    return out


def nearest(
    embeddings: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vec: str = "embedding",
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED, **sizes: int,
) -> DataFrame:
    """The k rows of largest cosine for each row whose id is divisible by `every`.

    Every vector is indexed, in `tables` hash tables of floor((a.x + b) / width), a normal, on the unit sphere; a query
    visits `probes` buckets a table in order of estimated success, and the union of what they hold is ranked by exact
    cosine in double precision on the original vectors. A query whose buckets hold fewer than it asks for is ranked
    against its whole shard instead. No bucket is capped. The tables are per shard of fixed size,
    so recall does not change with the number of rows.

    Defined cases: null, zero, empty or non-finite vectors and null ids take no part; vectors of another dimension are
    never compared; copies are candidates of each other; ties go to the smaller id; of rows that repeat a
    query's id, one is its own; an empty table gives no rows.
    """

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.where(F.exists("vec", lambda x: x != 0))

    def rank(shard: Block, chunk: Block, keep: int, floors: np.ndarray) -> list:
        dim = shard.vecs.shape[1]
        rng = np.random.default_rng([seed, dim])
        norm = lambda v: v / np.abs(v).max(1, keepdims=True)  # noqa: E731  against overflow and underflow of squares
        length = lambda v: np.sqrt((v * v).sum(1))
        xs, qs = norm(shard.vecs), norm(chunk.vecs)
        nx, nq = length(xs), length(qs)
        ux, uq = xs / nx[:, None], qs / nq[:, None]
        found = np.zeros((len(qs), len(xs)), bool)
        for _ in range(tables):
            a, b = rng.normal(size=(dim, projections)), rng.uniform(0, width, projections)
            cells = np.floor((ux @ a + b) / width).astype(np.int64)
            buckets, inside = np.unique(_numbers(cells), return_inverse=True)
            at = (uq @ a + b) / width
            home = np.floor(at).astype(np.int64)
            visit = _numbers(home[:, None, :] + probe_order(at - home, probes))
            slot = np.minimum(np.searchsorted(buckets, visit), len(buckets) - 1)
            opened = np.zeros((len(qs), len(buckets)), bool)
            hit = buckets[slot] == visit
            opened[np.nonzero(hit)[0], slot[hit]] = True
            for q0 in range(0, len(qs), 512):
                found[q0 : q0 + 512] |= opened[q0 : q0 + 512][:, inside]
        out = []
        for q in range(len(qs)):
            rows = np.flatnonzero(found[q])
            if shard.counts[rows].sum() < keep:
                rows = np.arange(len(xs))
            if len(rows):
                score = (xs[rows] @ qs[q]) / (nx[rows] * nq[q])
                if len(rows) > keep:
                    least = np.partition(score, len(score) - keep)[len(score) - keep]
                    rows, score = rows[score >= least], score[score >= least]
                out.append((q, *shard.expand(rows, score, keep)))
        return out

    return search(embeddings, rank, k, every, vec_id, vec, prepare, "double", **sizes)
