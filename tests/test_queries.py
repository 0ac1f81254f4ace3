"""Every registered query against its SQL in DuckDB on a small data set."""

import pytest

from compare import connect, rows_of, sql_rows
from stratavox.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name not in SQL:
        assert df.count() > 0
        return
    names, want = sql_rows(con, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
