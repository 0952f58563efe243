"""Searches by masks, from both ends and by peeling, against plain ones."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from topolake.operators import kernel as K
from topolake.operators import provenance as P
from topolake.operators import small
from topolake.sources import sales


def graph(seed, n=60, m=90, dag=False):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in pairs if not dag or a < b})


def plain_reach(edges, seed):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    seen, todo = set(), [seed]
    while todo:
        for b in after[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def frame(spark, edges):
    return spark.createDataFrame([("d", a, b) for a, b in edges], "dataset string, src string, dst string")


@pytest.mark.parametrize("n", [20, 150])
def test_masks_of_more_seeds_than_a_long_has_bits(spark, n):
    edges = graph(n, n, 2 * n)
    seeds = sorted({x for e in edges for x in e})
    masks, placed = K.reach_masks(frame(spark, edges), spark.createDataFrame([("d", s) for s in seeds], "dataset string, seed string"))
    found = {(r["seed"], r["node"]) for r in K.by_seed(masks, placed).collect()}
    assert found == {(s, t) for s in seeds for t in plain_reach(edges, s)}


def test_cascades_count_leaves_of_one_and_of_several_parents(spark):
    edges = [("a", 0, "b", i) for i in range(4)] + [("b", i, "c", j) for i in range(4) for j in (i, i + 1, 10 * i)] + [("c", 0, "a", 1), ("a", 1, "b", 9)]
    df = spark.createDataFrame(edges, P.ROW_EDGES)
    seeds = P.rows_of(df)
    found = {(r["seed_table"], r["seed_row"], r["table"]): r["n_rows"] for r in P.cascade(df, seeds).collect()}
    pairs = {((s, i), (t, j)) for s, i, t, j in edges}
    want = {}
    for seed in {x for e in pairs for x in e}:
        for t, _ in (reached := plain_reach(pairs, seed)):
            want[(*seed, t)] = want.get((*seed, t), 0) + 1
        if reached:
            want[(*seed, None)] = len(reached)
    assert found == want


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_from_both_ends_are_the_least(spark, seed):
    edges = graph(seed)
    names = sorted({x for e in edges for x in e})
    r = random.Random(seed)
    pairs = [(i, r.choice(names), r.choice(names)) for i in range(25)] + [(99, names[0], names[0])]
    got = {x["pair"]: x["path"] for x in K.paths_between(frame(spark, edges), spark.createDataFrame([("d", *p) for p in pairs], "dataset string, pair int, s string, t string")).collect()}
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    want = {}
    for i, s, t in pairs:
        level, seen = deque([[s]]), {s: 0}
        best = None
        while level:
            path = level.popleft()
            if best and len(path) > len(best):
                break
            if path[-1] == t:
                best = min(best, path) if best else path
            for b in after[path[-1]]:
                if seen.get(b, len(path)) >= len(path):
                    seen[b] = len(path)
                    level.append([*path, b])
        if best:
            want[i] = best
    assert got == want


def test_longest_paths_and_cycles(spark):
    edges = graph(5, 40, 70, dag=True)
    depth = {}
    for _ in range(41):
        for a, b in edges:
            depth[a], depth[b] = depth.get(a, 0), max(depth.get(b, 0), depth.get(a, 0) + 1)
    assert {r["node"]: r["depth"] for r in K.longest(frame(spark, edges)).collect()} == depth
    assert K.longest(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        K.longest(frame(spark, [("a", "b"), ("b", "c"), ("c", "b")]))


def test_small_graphs_are_bounded_by_work(spark):
    edges = frame(spark, [(f"x{i}", f"x{i + 1}") for i in range(100)])
    seeds = edges.select("dataset", "src")
    assert small.fits(edges, seeds) and not small.fits(edges, seeds, work=9_999) and not small.fits(edges, rows=99)
    with small.never():
        assert not small.fits(edges)
    assert small.fits(edges)


def test_tables_reached_goes_by_tables_and_equals_the_trace(spark, monkeypatch):
    # 70 tables, more than one word has bits for, in four layers and by leaps; rows meet by remainders.
    rows = [(f"t{i:02}", (k * 5 + i) % 7, f"t{j:02}", k) for i in range(69) for j in {i + 30, i + 40, 69} if i < j < 70 for k in range(7) if (k + j) % 6 and (i + j) % 4]
    edges = spark.createDataFrame(rows, P.ROW_EDGES)
    for upstream, of, keep in ((True, "t6", "t"), (True, "t65", "t0"), (False, "t0", "")):
        seeds = P.rows_of(edges).where(F.col("table").startswith(of))
        old = {}
        for r in P.trace(edges, seeds, upstream).where(F.col("table").startswith(keep)).collect():
            old.setdefault((r["seed_table"], r["seed_row"]), set()).add(r["table"])
        with monkeypatch.context() as m:
            m.setattr(P, "trace", None)  # pairs of a seed and a row would not fit on a warehouse
            assert {(r["seed_table"], r["seed_row"]): r["tables"] for r in P.tables_reached(edges, upstream, of, keep).collect()} == {k: sorted(v) for k, v in old.items()}


def test_tables_reached_in_a_circle(spark):
    edges = spark.createDataFrame([("a", 1, "b", 1), ("b", 1, "a", 2), ("a", 2, "b", 3), ("c", 1, "a", 1)], P.ROW_EDGES)
    assert {(r["seed_table"], r["seed_row"]): r["tables"] for r in P.tables_reached(edges, True, "b").collect()} == {("b", 1): ["a", "c"], ("b", 3): ["a", "b", "c"]}
    assert P.tables_reached(edges, True, "none").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cascades_of_all_rows_go_by_tables(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(f"t{a}", r.randrange(5), f"t{b}", r.randrange(5)) for a, b in ((r.randrange(6), r.randrange(6)) for _ in range(80)) if a < b]
    pairs, want = {((s, i), (t, j)) for s, i, t, j in edges}, {}
    for row in {x for e in pairs for x in e}:
        for t, _ in (reached := plain_reach(pairs, row)):
            want[(*row, t)] = want.get((*row, t), 0) + 1
        if reached:
            want[(*row, None)] = len(reached)
    monkeypatch.setattr(K, "reach_masks", None)  # a bit for each row of a warehouse
    assert {(r["seed_table"], r["seed_row"], r["table"]): r["n_rows"] for r in P.cascade(spark.createDataFrame(edges, P.ROW_EDGES)).collect()} == want


def test_longest_depths_go_by_tables(spark, monkeypatch):
    r = random.Random(5)
    edges = [(f"t{a}", r.randrange(6), f"t{b}", r.randrange(6)) for a, b in ((r.randrange(5), r.randrange(5)) for _ in range(60)) if a < b]
    want = {(t, i): 0 for e in edges for t, i in (e[:2], e[2:])}
    for s, i, t, j in sorted(edges, key=lambda e: e[0]):  # sources first
        want[t, j] = max(want[t, j], want[s, i] + 1)
    monkeypatch.setattr(K, "longest", None)  # a round writes what is left of all edges
    found = P.longest_depths(spark.createDataFrame(edges, P.ROW_EDGES)).collect()
    assert len(found) == len(want) and {(x["table"], x["row"]): x["depth"] for x in found} == want


def test_longest_depths_in_a_circle_of_tables(spark):
    edges = [("a", 1, "b", 1), ("b", 1, "a", 2), ("a", 2, "b", 3)]
    assert {(x["table"], x["row"]): x["depth"] for x in P.longest_depths(spark.createDataFrame(edges, P.ROW_EDGES)).collect()} == {("a", 1): 0, ("b", 1): 1, ("a", 2): 2, ("b", 3): 3}
    with pytest.raises(ValueError, match="cycle"):
        P.longest_depths(spark.createDataFrame([*edges, ("b", 3, "a", 1)], P.ROW_EDGES))


@pytest.mark.parametrize("seed", range(2))
def test_cascades_of_seeds_go_by_tables(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(f"t{a}", r.randrange(5), f"t{b}", r.randrange(5)) for a, b in ((r.randrange(6), r.randrange(6)) for _ in range(80)) if a < b] + [("t0", None, "t5", 9)]
    pairs, want = {((s, i), (t, j)) for s, i, t, j in edges}, {}
    seeds = [(f"t{a}", i) for a in (0, 2, 5) for i in range(7)] + [("none", 1)]
    seeds += [("t1", i) for i in range(70)]  # more than a long has bits
    for row in seeds:
        for t, _ in (reached := plain_reach(pairs, row)):
            want[(*row, t)] = want.get((*row, t), 0) + 1
        if reached:
            want[(*row, None)] = len(reached)
    monkeypatch.setattr(K, "reach_masks", None)  # rounds over all the edges' pairs of structs
    found = P.cascade(spark.createDataFrame(edges, P.ROW_EDGES), spark.createDataFrame(seeds, "table string, row bigint"))
    assert {(r["seed_table"], r["seed_row"], r["table"]): r["n_rows"] for r in found.collect()} == want


def test_numbers_of_lines_need_no_window(spark, tmp_path):
    keys = [1] * 3 + [2] * 1002 + [3] * 2 + [None] * 2
    line = spark.createDataFrame([(k, i % 7, i, i, float(i), 1.0, "d") for i, k in enumerate(keys)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_shipdate string")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    bag = lambda df: sorted(map(str, df.select("l_orderkey", "row").collect()))
    rows = sales.line_rows(spark, str(tmp_path))
    assert bag(rows) == bag(sales.lines(spark, str(tmp_path))) and len(bag(rows)) == len(keys)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
