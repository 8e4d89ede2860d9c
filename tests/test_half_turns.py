"""Queries that unwrap angles against their SQL where steps are half a turn, which the last digit of an angle decides."""

import duckdb
import pandas as pd
import pytest

from pathfield.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tracks whose values go up and down by 5.00, which is half a turn, or by twice as much."""
    path = tmp_path_factory.mktemp("half_turns")
    values = [round(0.17 * (i // 60) + step, 2) for i in range(24_000) for step in [(0, 5, 15)[i % 3]]]
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(values)), unit="s")
    events = pd.DataFrame({"event_id": range(len(values)), "ts": at.astype("datetime64[us]"), "user_id": [i // 60 for i in range(len(values))], "event_type": "view", "value": values, "props": '{"k": 1}'})
    events.to_parquet(path / "events.parquet")
    return path


@pytest.mark.parametrize("name", ["unwrap", "track_sets"])
def test_half_turns_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    found, expected = (df.sort_values(["t", "f"]).reset_index(drop=True) for df in (QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLES[name]).df()))
    assert len(found) > 1000
    pd.testing.assert_frame_equal(found[expected.columns.tolist()], expected, check_dtype=False, rtol=0, atol=2e-6)
