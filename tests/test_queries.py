"""Every registered engine query against its SQL."""

import pytest

from craterloom.plans import catalog_all as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_against_sql(name, spark, data, same):
    same(engine.QUERIES[name](spark, data), engine.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_rows(name, spark, data):
    df = engine.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(engine.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
