"""Every text query that has SQL gives the SQL's rows at the smallest scale."""

import duckdb
import pytest

from rasterloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(Q.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(str([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())
    assert want and sorted(str([r[c] for c in cols]) for r in df.collect()) == want
