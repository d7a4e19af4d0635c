"""Registered queries vs their DuckDB oracles on the sf0.001 tables (a sample from every section;
``tools/check_oracles.py`` runs all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import BASE, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["s01", "p02", "p04", "j02", "j04", "j07", "a03", "a05", "a09", "a14", "a15", "a17", "w01", "w03", "t01",
          "t05", "u03", "x01", "x12", "q04", "q09", "q17", "q20", "q23", "k03", "k06", "f02", "f05", "f06",
          "m02", "m05", "m07", "m16", "m25", "s07"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    spark_rows = rows_of(entry.queries()[name](spark, SF).toPandas())
    oracle_rows = rows_of(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert spark_rows[0] == oracle_rows[0]          # column names
    assert len(spark_rows[1]) == len(oracle_rows[1])
    assert spark_rows[1] == oracle_rows[1]
