"""Queries with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from actloom.llm import registry
from actloom.views import TABLES

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert got and got == want
