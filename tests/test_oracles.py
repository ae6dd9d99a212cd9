"""Every core query with SQL against DuckDB over whole tables."""

import glob
import os

import duckdb
import pytest

from leafmill.plans import catalogue


@pytest.fixture(scope="module")
def db(tables):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, db, name):
    df = catalogue.QUERIES[name](spark, tables)
    rows = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in rows.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(str(r[columns.index(c)]) for c in order) for r in rows.fetchall())
    assert got == want


def test_the_sample_has_every_kind_of_chunk(spark, tables):
    kinds = {r.chunk_type for r in catalogue.QUERIES["section_chunks"](spark, tables).select("chunk_type").distinct().collect()}
    assert kinds == {"text", "table", "figure", "formula", "code"}
