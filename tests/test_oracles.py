"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from fathomix.plans.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations events lineitem orders".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.sql(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    assert columns == sorted(df.columns)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
