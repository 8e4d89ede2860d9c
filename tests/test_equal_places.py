"""Queries of pairs against their SQL where dots share a place, so that displacements of exactly 0 lie on the edge of two bins."""

import duckdb
import pytest

from pathfield.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g_xy_weighted"])
def test_equal_places_as_in_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"copy (select vec_id + k * 1000 as vec_id, * exclude (vec_id) from '{DATA}/embeddings.parquet', (select unnest(range(3)) as k)) to '{tmp_path}/embeddings.parquet'")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    found, expected = (df.sort_values(["i", "j"]).reset_index(drop=True) for df in (QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLES[name]).df()))
    assert found[["i", "j", "n"]].values.tolist() == expected[["i", "j", "n"]].values.tolist()
    # the sums run to millions, and engines add in another order
    assert found["g"].tolist() == pytest.approx(expected["g"].tolist(), rel=1e-9)
