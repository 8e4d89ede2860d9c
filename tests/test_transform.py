"""Lag statistics by transforms against all pairs."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathfield.operators import lag


def walk(n, seed=0, gaps=0.2, unknown=0.1):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"t": seed, "f": np.arange(n) + 7, "x": rng.normal(size=n).cumsum() + 100, "y": rng.normal(size=n).cumsum(), "o": rng.normal(size=n).cumsum() / 5})
    d = d[rng.random(n) > gaps].reset_index(drop=True)
    for c in "xyo":
        d[c] = d[c].astype(object)
        d.loc[rng.random(len(d)) < unknown, c] = None
    return d


DDL = "t long, f int, x double, y double, o double"
#: Means by name, and whether negative lags are asked for.
ALL = {
    "msd": (lag._displacement, False),
    "body": (lag._body, False),
    "mean": (lambda: lag._product("x", "o", "mean"), True),
    "init": (lambda: lag._product("x", "y", "init"), True),
    "plain": (lambda: lag._product("y", "x", None), True),
}


@pytest.fixture(scope="module")
def tracks(spark):
    # a row more in some frames, a track of one row, one of unknown values only
    more = walk(40, 3).iloc[:9].assign(x=1.5)
    none = pd.DataFrame({"t": 5, "f": range(4), "x": [None] * 4, "y": [None] * 4, "o": [None] * 4})
    return spark.createDataFrame(pd.concat([walk(90, 1), walk(65, 2, 0, 0), walk(40, 3), more, walk(1, 4, 0, 0), none]).replace({np.nan: None}), DDL).cache()


def rows(df):
    return {(r["t"], r["tau"]): {k: -99.0 if v is None else v for k, v in r.asDict().items()} for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"whole": 8, "band": 2}])
@pytest.mark.parametrize("name", sorted(ALL))
def test_transform_equals_pairs(spark, tracks, name, sizes):
    what, both = ALL[name][0](), ALL[name][1]
    expected = rows(lag._all_pairs(tracks, what.columns, both, "t", "f").groupBy("t", "tau").agg(*[F.avg(c).alias(k) for k, c in what.pairs.items()]))
    got = rows(lag._by_transform(tracks, what, both, **sizes))
    if name == "mean":  # the means themselves shift with the centre, what crosscorr makes of them does not
        expected, got = ({k: {"c": -99.0 if -99.0 in (r["m"], r["a"], r["b"]) else r["m"] - r["a"] * r["b"]} for k, r in x.items()} for x in (expected, got))
    assert got.keys() == expected.keys() and len(got) > 100
    for k, r in expected.items():
        assert got[k] == pytest.approx(r, rel=1e-9, abs=1e-9), k


def test_forms_of_one_table(spark):
    """Short, long and sparse tracks side by side; the long one has the reference workload's 3,864 frames."""
    long, sparse = walk(3_864, 1), walk(600, 2, 0, 0)
    sparse["f"] = sparse["f"] * 100_000
    short = pd.concat([walk(n, 10 + n) for n in (2, 30)])
    d = spark.createDataFrame(pd.concat([long, sparse, short]).replace({np.nan: None}), DDL)
    got = lag.msd(d).toPandas()
    own = got[got["t"] == 1].set_index("tau")["msd"]
    x, y = (np.full(3_864, np.nan) for _ in "xy")
    at = long["f"].to_numpy() - 7
    x[at], y[at] = long["x"].astype(float), long["y"].astype(float)
    for tau in [0, 1, 2, 17, 500, 2_000, 3_800]:
        q = (x[tau:] - x[: len(x) - tau]) ** 2 + (y[tau:] - y[: len(y) - tau]) ** 2
        assert own[tau] == pytest.approx(np.nanmean(q), rel=1e-9, abs=1e-9)
    s = got[got["t"] == 2].set_index("tau")["msd"]
    assert len(s) == 600 and s[100_000] == pytest.approx(np.mean(np.diff(sparse["x"].astype(float)) ** 2 + np.diff(sparse["y"].astype(float)) ** 2))
    for f in (lag.nn_corr, lag.rn_corr, lag.rr_stack, lag.msd_ensemble):
        assert f(d).count() > 0


def test_all_lags_of_a_million_frames(spark):
    """A ballistic track: squared displacements are tau^2; the work has to grow as L log L."""
    n = 1_000_000
    d = spark.range(n).select(F.lit(1).cast("long").alias("t"), F.col("id").cast("int").alias("f"), (F.col("id") * 0.001).alias("x"), F.lit(0.0).alias("y"))
    began = time.time()
    got = lag.msd(d).where("tau % 99999 = 1 or tau = 0 or tau = 999999").toPandas().set_index("tau")["msd"]
    assert time.time() - began < 240
    assert len(got) == 13 and got[0] == pytest.approx(0, abs=1e-5)
    assert all(v == pytest.approx((tau * 0.001) ** 2, rel=1e-6, abs=1e-5) for tau, v in got.items())
