"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell import queries as core


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return connection


def keyed(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_like_sql(spark, data, duck, name):
    rows = core.QUERIES[name](spark, data)
    columns = sorted(rows.columns)
    ours = sorted(tuple(map(keyed, r)) for r in rows.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(core.ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(keyed(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source_table", "row_key", "field", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
