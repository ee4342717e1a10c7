"""Queries of the training-data operators that SQL can express too give the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("policy_export_dirty", "documents", "eval_passages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    theirs = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, data).select(*columns).collect()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, theirs.fetchall())) and ours
