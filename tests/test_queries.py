"""Every query of the engine's own operators against its SQL."""

import pytest

from topolake.plans.registry import oracle_sql, queries

ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(queries()[name](spark, sf_dir), duck, ORACLE[name])


def test_bootstrap_interval_holds_the_mean(spark, sf_dir):
    for r in queries()["a20_bootstrap_interval"](spark, sf_dir).collect():
        assert r["low"] <= r["em"] <= r["high"]
        assert r["high"] - r["low"] < 0.2


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
