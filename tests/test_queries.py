"""Every query of the library against its SQL."""

import pytest

from factloom.plans import catalogue

from .conftest import SF, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 8


def test_specialist_has_both_charts(spark):
    from factloom.plans.registry import Tables

    t = Tables(spark, SF)
    got = QUERIES["adp_specialist"](spark, SF)
    assert got.count() == t.claims.count() + t.scored.count()
    assert {"validated", "CONFIRMED"} <= {r["status"] for r in got.select("status").distinct().collect()}
