"""Tools called by SQL: what they give and what they raise."""

import pytest
from pyspark.errors import AnalysisException, SparkRuntimeException

from topolake import sql_tools


@pytest.fixture(scope="module")
def session(spark, sf_dir):
    own = spark.newSession()
    sql_tools.register(own, sf_dir)
    return own


def rows(session, sql):
    return sorted(tuple(r) for r in session.sql(sql).collect())


def test_five_tools(session):
    assert ("orders",) in rows(session, "SELECT * FROM list_tables('star')") and rows(session, "SELECT * FROM list_tables('none')") == []
    assert rows(session, "SELECT * FROM check_direct_fk('star', 'orders', 'customer')") == [(True,)]
    assert rows(session, "SELECT * FROM check_direct_fk('star', 'orders', 'region')") == [(False,)]
    up, down = (rows(session, f"SELECT * FROM lineage_of('syn_cross', '{t}', '{w}')") for t, w in (("dim_employee", "backward"), ("stg_employees_cleaned", "forward")))
    assert ("stg_employees_cleaned",) in up and ("dim_employee",) in down
    nations = rows(session, "SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
    assert rows(session, "SELECT * FROM trace_row('region', 1, 'forward')") == [("nation", 5, [n for (n,) in nations])]
    assert rows(session, "SELECT * FROM trace_row('region', 99, 'forward')") == [] == rows(session, "SELECT * FROM trace_row('region', 1, 'backward')")
    found = rows(session, "SELECT * FROM second_sources('customer', 3)")
    assert found == rows(session, "SELECT 'region', n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 3")


def test_matching_keeps_the_tables_columns(session):
    got = session.sql("SELECT * FROM matching(TABLE(nation), 'n_regionkey', '1')")
    assert got.columns == session.table("nation").columns and got.count() == 5
    assert session.sql("SELECT * FROM matching(TABLE(SELECT * FROM nation WHERE false), 'n_name', 'x')").count() == 0


@pytest.mark.parametrize("call", ["trace_row('nope', 1, 'forward')", "trace_row(NULL, 1, 'forward')", "second_sources('nope', 1)", "lineage_of('star', 'nope', 'forward')", "check_direct_fk('star', 'nope', 'region')"])
def test_unknown_tables_raise(session, call):
    with pytest.raises(SparkRuntimeException, match="UNKNOWN_TABLE") as x:
        session.sql(f"SELECT * FROM {call}").collect()
    assert x.value.getCondition() == "USER_RAISED_EXCEPTION"


def test_unknown_directions_and_columns_raise(session):
    with pytest.raises(SparkRuntimeException, match="UNKNOWN_DIRECTION sideways"):
        session.sql("SELECT * FROM trace_row('orders', 1, 'sideways')").collect()
    with pytest.raises(AnalysisException, match="UNKNOWN_COLUMN nope"):
        session.sql("SELECT * FROM matching(TABLE(nation), 'nope', '1')")


def test_calls_read_only_the_tables_that_they_name(session):
    plan = lambda sql: session.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    traced = plan("SELECT c_custkey, t.* FROM customer, LATERAL trace_row('customer', c_custkey, 'forward') t")
    assert "o_custkey" in traced and "l_orderkey" not in traced and "n_regionkey" not in traced
    assert "l_orderkey" not in plan("SELECT s.* FROM orders, LATERAL second_sources('orders', o_orderkey) s")
    # One stage raises, and no table is read for it.
    assert "Relation" not in plan("SELECT * FROM trace_row('nope', 1, 'forward')")
    with pytest.raises(SparkRuntimeException, match="UNKNOWN_TABLE nope"):
        session.sql("SELECT count(*) FROM trace_row('nope', 1, 'forward')").collect()


def test_names_may_come_from_columns(session):
    asked = "VALUES ('region', 1, 'forward'), ('nation', 3, 'backward'), ('nation', 3, 'backward'), ('nation', NULL, 'forward') a(n, r, w)"
    got = [r for r in rows(session, f"SELECT a.n, t.other, t.n_rows FROM {asked}, LATERAL trace_row(a.n, a.r, a.w) t")]
    assert got == [("nation", "region", 1), ("nation", "region", 1), ("region", "nation", 5)]
    with pytest.raises(SparkRuntimeException, match="UNKNOWN_TABLE nope"):
        rows(session, "SELECT t.* FROM VALUES ('region', 1), ('nope', 3) a(n, r), LATERAL trace_row(a.n, a.r, 'forward') t")


def test_tools_of_rows_draw_no_table_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sql_tools, "load", None)  # joins all lines with their orders
    from topolake.plans.functions import Q

    assert Q["u1_sql_trace_row"](spark, sf_dir).count() > 0
