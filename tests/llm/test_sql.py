"""Every query of this list that SQL can express, against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from eventloom.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = connection.sql(oracle.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(str(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(str(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall())
