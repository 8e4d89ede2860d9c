"""Running values of cut tracks against plain windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathfield.operators import noise, scans, sequence, tracksets

DDL = "t long, f int, x double, y double, o double, id long"


@pytest.fixture(scope="module")
def tracks(spark):
    """A track with most rows, runs of NULLs over several pieces and at both ends, gaps, short tracks and one without a name."""
    rng = np.random.default_rng(4)
    parts = []
    for t, n, gap in ((1, 700, 3), (2, 40, 1), (3, 1, 1), (None, 60, 2)):
        f = np.cumsum(rng.integers(1, gap + 1, n))
        x = rng.integers(-9, 9, n).cumsum().astype(float)
        d = pd.DataFrame({"t": t, "f": f, "x": x, "y": -x / 3, "o": rng.normal(size=n).cumsum() * 3 % 6, "id": f}).astype(object)
        for a, b in ((0, 9), (100, 220), (300, 304), (n - 30, n)):
            d.loc[a : b - 1, ["x", "o"]] = None
        parts.append(d)
    return spark.createDataFrame(pd.concat(parts).replace({np.nan: None}), DDL).cache()


def rows(df):
    return sorted(repr({k: round(v, 7) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in df.collect())


CASES = {
    "unwrap": lambda d, n: sequence.unwrap(d, large=n),
    "densify": lambda d, n: sequence.densify(d, large=n),
    "densify_drop": lambda d, n: sequence.densify(d, drop_over=1, large=n),
    "interpolate": lambda d, n: sequence.interpolate(d, ["x", "o"], 15, large=n),
    "repair": lambda d, n: sequence.repair(d, ["x"], 200, large=n),
    "forward": lambda d, n: sequence.differenced(d, "dx", "x", large=n),
    "central": lambda d, n: sequence.differenced(d, "dx", "x", True, large=n),
    "gauss": lambda d, n: sequence.gauss_filtered(d, {"a": ("x", 0.65, 1), "y": ("y", 1.5, 0)}, large=n),
    "area": lambda d, n: sequence.cumulative_trapezoid(d, "y", "f", "t", large=n),
    "limited": lambda d, n: sequence.limited_means(d, "x", large=n),
    "extrema": lambda d, n: sequence.running_extrema_start(d.withColumn("v", F.col("f") + F.col("y") / 50), "v", "t", "f", large=n),
    "displaced": lambda d, n: sequence.displaced(d, large=n),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cut_equals_plain(tracks, name, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 16)
    monkeypatch.setattr(scans.Scan.__init__, "__defaults__", ("t", "f", scans.LARGE, 16))
    monkeypatch.setattr(scans.halo, "__defaults__", ("t", "f", scans.LARGE, 16))
    assert rows(CASES[name](tracks, 50)) == rows(CASES[name](tracks, None))


def test_pieces(tracks):
    """A large track is dealt over about sqrt(n) pieces; others stay whole."""
    sizes = {(r["t"], r["__s"]): r["count"] for r in scans.Scan(tracks, large=50, piece=1).df.groupBy("t", "__s").count().collect()}
    assert len([k for k in sizes if k[0] == 1]) == 27 and sizes[2, None] == 40 and sizes[3, None] == 1
    assert max(n for (t, _), n in sizes.items() if t == 1) < 60


def test_columns_agree(tracks):
    """The Columns for a select give what the tables' functions give."""
    a = tracks.withColumn("dx", sequence.gauss_filter("y", 1.5, 1))
    assert rows(a) == rows(sequence.gauss_filtered(tracks, {"dx": ("y", 1.5, 1)}))
    assert rows(tracks.withColumn("dx", sequence.gradient("x"))) == rows(sequence.differenced(tracks, "dx", "x", True))


def test_slices_and_velocities_of_cut_tracks(tracks, monkeypatch):
    plain = {k: rows(tracksets.sliced(tracks, k)) for k in ("3:90:4", ":-50", "-9:", ":7:-1")}
    speeds = rows(noise.velocities(tracks))
    monkeypatch.setattr(scans.Scan.__init__, "__defaults__", ("t", "f", 50, 16))
    for k, v in plain.items():
        assert rows(tracksets.sliced(tracks, k)) == v, k
    monkeypatch.setattr(sequence.gauss_filtered, "__defaults__", ("t", "f", 50))
    assert rows(noise.velocities(tracks)) == speeds
