"""Kernel operators on hand-written graphs, by joins and by whole-graph search."""

from contextlib import nullcontext
import pytest
from pyspark.sql import functions as F

from topolake.operators import kernel as K
from topolake.operators import provenance as P
from topolake.operators import scoring as S
from topolake.operators import small
from topolake.operators import text as X
from topolake.operators import topology as T
from topolake.tools import TOOLS, UnknownToolError

FK = [("b", "a"), ("c", "a"), ("c", "b"), ("d", "c"), ("d", "c"), ("e", "e")]
LINEAGE = [("a", "f"), ("f", "g"), ("g", "f")]


@pytest.fixture(params=["whole", "rounds"])
def way(request):
    with small.never() if request.param == "rounds" else nullcontext():
        yield request.param


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("h1", i, n) for i, n in enumerate("abcdefgh")], "dataset string, node_id int, name string")
    rows = [("h1", a, b, "fk_to") for a, b in FK] + [("h1", a, b, "derived_from") for a, b in LINEAGE]
    return nodes, spark.createDataFrame(rows, "dataset string, src string, dst string, edge_type string")


def _by(rows, key, value):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r[value])
    return out


def test_components(graph, way):
    found = {frozenset(v) for v in _by(K.components(*graph).collect(), "comp", "name").values()}
    assert found == {frozenset("abcdfg"), frozenset("e"), frozenset("h")}


def test_lineage(graph, way):
    edges = graph[1]
    assert _by(T.reverse(edges).collect(), "name", "source")["f"] == {"a", "g"}
    closed = _by(T.closure(edges).collect(), "seed", "node")
    assert closed["a"] == {"f", "g"} and closed["f"] == {"g"}


def test_join_paths(graph, way):
    nodes, edges = graph
    paths = {(r["s"], r["t"]): r["path"] for r in T.join_paths(nodes, edges, "fk_to").collect()}
    assert paths["d", "a"] == ["d", "c", "a"] and paths["d", "f"] == [] and paths["h", "h"] == ["h"]
    hops = {(r["s"], r["t"]): r["hops"] for r in T.hop_counts(nodes, edges, "fk_to").collect()}
    assert all(hops[k] == len(p) - 1 for k, p in paths.items())
    both = {(r["s"], r["t"]): r["path"] for r in T.join_paths(nodes, edges).collect()}
    assert both["d", "f"] == ["d", "c", "a", "f"]


def test_impact_variants(graph, way):
    got = {v: {r["name"]: r["impacted"] for r in T.combined_impact(graph[1], v).collect()}.get("a") for v in ("base", "extended", "both_ways", "full_search")}
    assert got == {"base": ["b", "c", "f", "g"], "extended": None, "both_ways": ["b", "c", "f", "g"], "full_search": ["f", "g"]}


def test_neighbours_and_direct(graph, way):
    nodes, edges = graph
    near = [r for r in T.neighbours(nodes, edges, 2, "fk_to").collect() if r["seed"] == "a"]
    assert {r["node"] for r in near if r["depth"] == 1} == {"b", "c"} and {r["node"] for r in near} == {"b", "c", "d"}
    direct = {(r["s"], r["t"]) for r in T.direct(nodes, edges).where("is_direct").collect()}
    assert ("c", "a") in direct and ("a", "c") not in direct


def test_rank_sums_to_one(graph, way):
    rank = {r["name"]: r["rank"] for r in K.page_rank(*graph, rounds=10).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["c"] > rank["h"]


def test_empty_graph(spark, graph, way):
    nodes, edges = graph
    none = edges.where("false")
    assert K.components(nodes, none).select("comp").distinct().count() == 8
    assert T.closure(none).count() == 0


def test_row_lineage(spark, way):
    rows = [("t", 0, "s", 0), ("t", 1, "s", 0), ("t", 1, "s", 1), ("s", 0, "m", 0), ("s", 1, "m", 0)]
    edges = spark.createDataFrame(rows, P.ROW_EDGES)
    assert {r["sources"][0] for r in P.sources(edges).where("table = 'm'").collect()} == {"s:row_0"}
    up = {(r["table"], r["row"]) for r in P.trace(edges, P.rows_of(edges).where("table = 'm'"), True).collect()}
    assert up == {("s", 0), ("s", 1), ("t", 0), ("t", 1)}
    total = {r["seed_row"]: r["n_rows"] for r in P.cascade(edges, P.rows_of(edges).where("table = 't'")).where("table IS NULL").collect()}
    assert total == {0: 2, 1: 3}
    assert P.depths(edges, P.rows_of(edges).where("table = 'm'")).first()["depth"] == 2


def test_scores(spark):
    kind = "answer_type string, pred string, pred_kind string, gold string, gold_kind string, pred_list array<string>, gold_list array<string>"
    cases = [
        (("list", None, "null", None, "str", ["A", "B", "B"], ["A", "C"]), (False, 0.5)), (("list", None, "null", None, "str", ["A"], []), (True, 1.0)),
        (("list", None, "null", None, "str", [], ["A"]), (False, 0.0)), (("list", None, "null", None, "str", ["dim_a row_3"], ["dim_a:row_3"]), (True, 1.0)),
        (("boolean", "Yes", "str", "true", "bool", None, None), (True, 1.0)), (("integer", "5.0", "str", "5", "int", None, None), (False, 0.0)),
        (("integer", "5.7", "float", "5", "int", None, None), (True, 1.0)), (("string", " Foo", "str", "foo", "str", None, None), (True, 1.0)),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], kind)
    assert [(r["exact_match"], r["f1"]) for r in S.score(rows).collect()] == [w for _, w in cases]


def test_other_shortest_path(spark):
    edges = spark.createDataFrame([("h2", a, b, "fk_to") for a, b in (("s", "x"), ("s", "y"), ("x", "t"), ("y", "t"))], "dataset string, src string, dst string, edge_type string")
    rows = spark.createDataFrame([(1, "h2", ["s", "y", "t"], ["s", "x", "t"]), (2, "h2", ["t", "x", "s"], ["s", "x", "t"]), (3, "h2", ["s", "q", "t"], ["s", "x", "t"])], "id int, dataset string, pred_list array<string>, gold_list array<string>")
    got = {r["id"]: r for r in S.score_paths(rows, edges).collect()}
    assert got[1]["valid_alt_path"] and got[1]["f1"] == 1.0
    assert got[2]["exact_match"] and not got[2]["order_correct"]
    assert not got[3]["valid_alt_path"] and not got[3]["exact_match"]


def test_recovered_json():
    assert X.recover_json(None) is None
    assert X.recover_json('x {"answer": [1]} y') == '{"answer": [1]}'
    assert X.recover_json("") == '{"answer": ""}'


def test_obfuscation_is_one_to_one_and_leaves_other_words(spark, graph):
    pairs = X.obfuscation(graph[0]).collect()
    assert len({r["obfuscated"] for r in pairs}) == len(pairs)
    rows = spark.createDataFrame([("orders_x orders, orders",)], "text string")
    assert X.obfuscate(rows, {"orders": "T"}).first()["text"] == "orders_x T, T"


def test_tools(spark):
    assert TOOLS.call(spark, "find_shortest_path", dataset="star", source="lineitem", target="region").first()["path"][0] == "lineitem"
    assert TOOLS.call(spark, "check_direct_fk", dataset="star", child="orders", parent="customer").first()["is_direct"]
    with pytest.raises(UnknownToolError):
        TOOLS.call(spark, "no_such_tool")
    with pytest.raises(TypeError):
        TOOLS.call(spark, "list_tables", wrong="x")


def test_append_once_repeats_nothing(spark, tmp_path):
    from topolake.streaming.events import append_once

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    for _ in range(2):
        append_once(spark.readStream.schema("id long").parquet(source), sink, "id")
        spark.range(3, 7).write.mode("append").parquet(source)
    assert spark.read.parquet(sink).where(F.col("id") < 7).count() == 7


def test_reach_goes_on_until_nothing_is_new(spark, way, monkeypatch):
    monkeypatch.setattr(K, "MAX_ROUNDS", 3)
    monkeypatch.setattr(K, "FOLDED_ROUNDS", 2, raising=False)
    names = [chr(97 + i) for i in range(8)]
    edges = spark.createDataFrame([("h", a, b) for a, b in zip(names, names[1:], strict=False)], "dataset string, src string, dst string")
    seeds = spark.createDataFrame([("h", "a")], "dataset string, seed string")
    found = K.reach(edges, seeds, paths=True)
    assert {r["node"]: (r["depth"], r["path"]) for r in found.collect()} == {n: (i, names[: i + 1]) for i, n in enumerate(names)}
    assert K.reach(edges, seeds, max_depth=2).count() == 3
    nodes = spark.createDataFrame([("h", i, n) for i, n in enumerate(names)], "dataset string, node_id int, name string")
    between = {r["name"]: r["betweenness"] for r in K.betweenness(nodes, edges).collect()}
    assert all(abs(between[n] - i * (7 - i) / 42) < 1e-9 for i, n in enumerate(names))


def test_reach_by_parts_is_reach(spark):
    # Layers, an edge that skips one, a cycle between two tables and one within a table, a repeated edge, a null table.
    pairs = [("a1", "b1"), ("a1", "b1"), ("b1", "c1"), ("a1", "c1"), ("c1", "d1"), ("b1", "d2"), ("d2", "b2"), ("b2", "d2"), ("c1", "c2"), ("c2", "c1"), ("e1", "a1"), ("_1", "a2")]
    node = lambda x: (None if x[0] == "_" else x[0], int(x[1]))
    edges = spark.createDataFrame([("g", node(a), node(b)) for a, b in pairs], "dataset string, src struct<table:string,row:bigint>, dst struct<table:string,row:bigint>")
    seeds = edges.select("dataset", F.col("src").alias("seed")).union(edges.select("dataset", "dst")).where("seed.table IS NOT NULL").distinct()
    rows = lambda df: sorted((tuple(r["seed"]), tuple(r["node"]), r["depth"]) for r in df.collect())
    for on_cycle in (True, False):
        whole = rows(K.reach(edges, seeds, start_on_cycle=on_cycle))
        with small.never():
            assert rows(K.reach(edges, seeds, start_on_cycle=on_cycle, part=lambda n: n["table"])) == whole
