"""Every text query with a DuckDB twin gives the same rows."""

import duckdb
import pytest

from tidemark.llm import queries as registered

SF = "/root/testdata/sf0.001"
Q, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = Q[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert got == sorted(map(str, duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()))
