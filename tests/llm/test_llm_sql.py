"""Every SQL text of the corpus operators against its query, over the smallest tables."""

import duckdb
import pytest

from pathfield.llm import queries

DATA = "/root/testdata/sf0.001"


def value(v):
    return None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, expected = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    found = sorted(repr([value(r[c]) for c in columns]) for r in got.collect())
    at = [expected.columns.index(c) for c in columns]
    assert found == sorted(repr([value(r[i]) for i in at]) for r in expected.fetchall())
