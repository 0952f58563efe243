"""Whole-graph routines for graphs that one task can hold: a schema's tables and references, not a warehouse's rows.

The kernel counts first: a search goes this way up to WORK starts times edges, other routines up to ROWS edges; beyond that
the kernel runs its joins round by round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROWS, WORK = 50_000, 5_000_000
_off: ContextVar[bool] = ContextVar("off", default=False)


def fits(edges: DataFrame, starts: DataFrame | None = None, rows: int = ROWS, work: int = WORK) -> bool:
    """Whether edges are at most `rows` and, searched from every start, at most `work`; reads no more than that of each."""
    if _off.get():
        return False
    n = edges.limit(rows + 1).count()
    if n > rows or starts is None:
        return n <= rows
    most = work // max(1, n)
    return starts.limit(most + 1).count() <= most


@contextmanager
def never() -> Iterator[None]:
    """Within, in this thread, no graph counts as small: the kernel goes round by round."""
    token = _off.set(True)
    try:
        yield
    finally:
        _off.reset(token)


def _key(v):
    return tuple(v.values()) if isinstance(v, dict) else v


def reacher(max_depth: int | None, start_on_cycle: bool, paths: bool):
    """For cogrouped (edges, seeds) of one dataset: level-by-level search from every seed."""

    def run(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        after, value = defaultdict(set), {}
        for a, b in zip(edges["src"], edges["dst"], strict=True):
            ka, kb = _key(a), _key(b)
            after[ka].add(kb)
            value[ka], value[kb] = a, b
        out = []
        for seed in seeds["seed"]:
            s = _key(seed)
            value.setdefault(s, seed)
            seen = set() if start_on_cycle else {s}
            level = {s: (s,)}
            if not start_on_cycle:
                out.append((seed, s, 0, level[s]))
            for depth in range(1, max_depth + 1) if max_depth else count(1):
                new: dict = {}
                for node in sorted(level) if paths else level:
                    for nxt in after.get(node, ()):
                        if nxt not in seen:
                            path = (*level[node], nxt) if paths else ()
                            if nxt not in new or path < new[nxt]:
                                new[nxt] = path
                if not new:
                    break
                seen.update(new)
                out += [(seed, n, depth, p) for n, p in new.items()]
                level = new
        name = [seeds["dataset"].iloc[0]] * len(out) if len(seeds) else []
        found = {"dataset": name, "seed": [r[0] for r in out], "node": [value[r[1]] for r in out]} | ({"path": [list(r[3]) for r in out]} if paths else {})
        table = pd.DataFrame({c: pd.Series(v, dtype="object") for c, v in found.items()})
        table.insert(3, "depth", np.array([r[2] for r in out], np.int32))
        return table

    return run


def united(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(dataset, name, comp) of one dataset: the least node number of each component."""
    parent = dict(zip(nodes["name"], nodes["name"], strict=True))
    number = dict(zip(nodes["name"], nodes["node_id"], strict=True))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["src"], edges["dst"], strict=True):
        ra, rb = sorted((root(a), root(b)), key=number.get)
        parent[rb] = ra
    return pd.DataFrame({"dataset": nodes["dataset"], "name": nodes["name"], "comp": [number[root(x)] for x in nodes["name"]]})


def ranker(damping: float, rounds: int):
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        """Power iteration over one dataset's edges, each given in both directions."""
        at = {x: i for i, x in enumerate(nodes["name"])}
        src = np.array([at[x] for x in edges["src"]], np.int64)
        dst = np.array([at[x] for x in edges["dst"]], np.int64)
        n = len(at)
        deg, rank = np.bincount(src, minlength=n), np.full(n, 1 / n)
        for _ in range(rounds):
            give = np.divide(rank, deg, out=np.zeros(n), where=deg > 0)
            rank = (1 - damping) / n + damping * (np.bincount(dst, give[src], n) + rank[deg == 0].sum() / n)
        return pd.DataFrame({"dataset": nodes["dataset"], "name": nodes["name"], "rank": rank})

    return run


def between(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(dataset, name, part) of one dataset: each node's share of the shortest paths between others, summed."""
    after = defaultdict(set)
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        after[a].add(b)
    part = dict.fromkeys(nodes["name"], 0.0)
    for s in nodes["name"]:
        depth, paths, before, order = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [s]
        for v in order:
            for w in sorted(after[v]):
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        got = defaultdict(float)
        for w in reversed(order[1:]):
            for v in before[w]:
                got[v] += paths[v] / paths[w] * (1 + got[w])
            if w in part:
                part[w] += got[w]
    return pd.DataFrame({"dataset": nodes["dataset"], "name": nodes["name"], "part": [part[x] for x in nodes["name"]]})
