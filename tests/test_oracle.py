"""Every raster query that has SQL gives the SQL's rows at the smallest scale."""

import math

import duckdb
import pytest

from rasterloom import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events embeddings"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(Q.oracle_sql()[name])
    names = rel.columns
    assert sorted(names) == cols
    assert mine == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
