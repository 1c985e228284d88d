"""Queries of this subpackage whose question SQL can express give DuckDB's rows, on the smallest tables."""

import os

import duckdb
import pytest

from linkgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == rows
