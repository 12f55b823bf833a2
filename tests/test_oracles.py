"""Every registered query of the engine against its DuckDB SQL."""

import math

import duckdb
import pytest

from actloom import queries as engine
from actloom.views import TABLES

QUERIES, ORACLES = engine.queries(), engine.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got, "no rows"
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = table(columns, cur.fetchall())
        assert len(got) == len(want)
        assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:2]


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
