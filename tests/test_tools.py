"""Tools on rows and schemas, against the edges that they read."""

from topolake.tools import TOOLS

EDGES = [("t", 0, "s", 0), ("t", 1, "s", 0), ("t", 1, "s", 1), ("s", 0, "m", 0), ("s", 1, "m", 0)]


def test_row_tools(spark):
    edges = spark.createDataFrame(EDGES, "src_table string, src_row bigint, dst_table string, dst_row bigint")
    rows = lambda name, **a: sorted(tuple(r) for r in TOOLS.call(spark, name, edges=edges, **a).collect())
    assert rows("trace_row_lineage", table="s", row=0) == [("t", [0, 1])]
    assert rows("trace_row_lineage", table="t", row=1, direction="forward") == [(["s:row_0", "s:row_1"], 2)]
    assert rows("trace_row_lineage", table="t", row=1, direction="forward", shown=1) == [(["s:row_0"], 2)]
    assert rows("get_row_provenance", table="m", row=0) == [("s", [0, 1]), ("t", [0, 1])]
    found = {r["table"]: r["n_rows"] for r in TOOLS.call(spark, "get_cascade_count", table="t", row=1, edges=edges).collect()}
    assert found == {"s": 2, "m": 1, None: 3}


def test_table_tools(spark, sf_dir):
    info = TOOLS.call(spark, "get_table_info", sf_dir=sf_dir, table="region").first()
    assert (info["n_rows"], info["n_columns"], len(info["samples"])) == (5, len(info["columns"]), 3)
    assert TOOLS.call(spark, "query_table", sf_dir=sf_dir, table="nation", columns=["n_name"], where="n_regionkey = 1").count() == 5
    silos = TOOLS.call(spark, "connected_components", dataset="star").collect()
    one = next(s for s in silos if "orders" in s["members"])
    assert TOOLS.call(spark, "silo_size", dataset="star", table="orders").first()["n_tables"] == one["n_tables"]
