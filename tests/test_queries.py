"""Every registered query of the engine against its SQL; those without SQL run and give rows of a stable schema."""

import pytest
from oracle import connect, rows

from rillstone import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.execute(SQL[name]).df())
    else:
        assert len(got.columns) > 1


def test_registered_names_have_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 150
