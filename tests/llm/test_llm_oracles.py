"""The queries with SQL against DuckDB over whole tables."""

import glob
import os

import duckdb
import pytest

from leafmill.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    df = catalogue.QUERIES[name](spark, tables)
    rows = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in rows.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r) for r in rows.fetchall())
