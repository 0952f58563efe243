"""Whole traces from the given tables, against the SQL, on a star with odd rows."""

import duckdb
import pytest

from topolake.operators import provenance as P
from topolake.plans import provenance, rederived
from topolake.sources import sales_traces

TABLES = {
    "region": "SELECT * FROM (VALUES (0, 'ASIA'), (1, 'MIDDLE EAST')) v(r_regionkey, r_name)",
    "nation": "SELECT * FROM (VALUES (0, 'a', 0), (1, 'b', 1), (2, 'c', 1), (3, 'of no region', 9)) v(n_nationkey, n_name, n_regionkey)",
    # A customer without orders, one of an unknown nation.
    "customer": "SELECT i::BIGINT AS c_custkey, (i % 4)::INTEGER AS c_nationkey, 'c' AS c_name, 'm' AS c_mktsegment FROM range(1, 9) r(i)",
    "supplier": "SELECT i::BIGINT AS s_suppkey, (i % 4)::INTEGER AS s_nationkey, 's' AS s_name FROM range(1, 8) r(i)",
    "part": "SELECT i::BIGINT AS p_partkey FROM range(1, 6) r(i)",
    # Keys far apart and below 0, orders without lines and of unknown or no customers.
    "orders": "SELECT CASE WHEN i = 3 THEN -7 ELSE i * 50000 END::BIGINT AS o_orderkey, CASE WHEN i = 5 THEN NULL WHEN i = 6 THEN 99 ELSE 1 + i % 7 END::BIGINT AS o_custkey FROM range(0, 15) r(i)",
    # Lines without a part, supplier or order, twice alike, and of one supplier and part in several orders.
    "lineitem": """SELECT CASE WHEN i % 15 = 3 THEN -7 WHEN i = 40 THEN NULL WHEN i = 41 THEN 77 ELSE (i % 13) * 50000 END::BIGINT AS l_orderkey, CASE WHEN i % 6 = 0 THEN NULL ELSE i % 5 END::BIGINT AS l_partkey,
      CASE WHEN i = 17 THEN NULL ELSE i % 9 END::BIGINT AS l_suppkey, CASE WHEN i = 20 THEN NULL ELSE i // 13 END::INTEGER AS l_linenumber, 1.0 AS l_quantity, 2.0 AS l_extendedprice, TIMESTAMP '2020-01-01' AS l_shipdate
      FROM (SELECT i FROM range(0, 70) r(i) UNION ALL SELECT 5) UNION ALL SELECT 50000, NULL, 1, 1, 1.0, 2.0, TIMESTAMP '2020-01-01'
      UNION ALL SELECT 700000, NULL, 2, 1, 1.0, 2.0, TIMESTAMP '2020-01-01'""",
}


def check(df, con, sql):
    """Rows agree, nulls among the keys too."""
    theirs = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in df.select(*names).collect())


@pytest.fixture
def odd(tmp_path):
    con = duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["v3_full_provenance", "v4_full_impact", "v6_lineage_depth", "v5_cascade_count_layered"])
def test_whole_traces_need_no_search(spark, odd, monkeypatch, name):
    path, con = odd

    def searched(*_, **__):
        raise AssertionError("rows' edges were searched")

    monkeypatch.setattr(P, "trace", searched)
    monkeypatch.setattr(provenance, "layered", searched)
    assert sales_traces.plain(spark, path)
    check(provenance.Q[name](spark, path), con, provenance.SQL[name])


def test_rederived_rows_need_no_search(spark, sf_dir, duck, monkeypatch):
    def searched(*_, **__):
        raise AssertionError("rows' edges were searched")

    monkeypatch.setattr(P, "trace", searched)
    monkeypatch.setattr(rederived.R, "tier2", searched)
    name = "x3_x4_rederived_rows"
    check(rederived.Q[name](spark, sf_dir), duck, rederived.SQL[name])


@pytest.mark.parametrize("name", ["v3_full_provenance", "v4_full_impact", "v6_lineage_depth"])
def test_repeated_keys_are_traced_by_edges(spark, odd, name):
    path, con = odd
    con.execute("DROP VIEW customer")
    con.execute(f"COPY ({TABLES['customer']} UNION ALL SELECT 2, 1, 'again', 'm') TO '{path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/customer.parquet'")
    assert not sales_traces.plain(spark, path)
    check(provenance.Q[name](spark, path), con, provenance.SQL[name])


def test_depths_by_tables_equal_the_search(spark, monkeypatch):
    cols = P.ROW_EDGES
    even = [("a", 1, "b", 1), ("a", 2, "b", 1), ("b", 1, "c", 1), ("b", 2, "c", 2), ("a", 9, "d", 9), ("d", 9, "c", 2)]
    found = lambda df: sorted(map(tuple, df.collect()))
    search, calls = P.trace, []
    monkeypatch.setattr(P, "trace", lambda *a, **k: calls.append(1) or search(*a, **k))
    # Ways of two lengths, and a chain that a null cuts, are searched.
    for more, searched in (([], 0), ([("a", 2, "c", 1)], 1), ([("b", None, "c", 3), ("a", 3, "b", None)], 1)):
        edges = spark.createDataFrame(even + more, cols)
        calls.clear()
        ours = found(P.depths(edges).where("seed_row IS NOT NULL"))
        assert len(calls) == searched
        assert ours == found(P.depths(edges, P.rows_of(edges).where("row IS NOT NULL")))
