"""Slice grids, prefix trees and what SQL can call."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfield.functions import forms, scalars, sql
from pathfield.operators import sequence, slices


def test_grid_of_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(t, int(f), float(1e6 + rng.gamma(2)) if rng.random() > 0.2 else None) for t in (1, 2) for f in range(5, 90 + t) if rng.random() > 0.3 or f == 5]
    d = spark.createDataFrame(rows, "t long, f int, v double")
    starts, stops = [0, 3, 80, 500], [1, 40, 0, -7, -90]
    for large in (None, 20):
        got = {(r.t, r.start, r.stop): r for r in slices.slice_grid(d, ["v"], starts, stops, "t", large=large).collect()}
        wanted = 0
        for t in (1, 2):
            mine = [(f - 5, v) for u, f, v in rows if u == t]
            n = max(f for f, _ in mine) + 1
            for a in starts:
                for b in stops:
                    part = [v for f, v in mine if a <= f < (b if b > 0 else n + b)]
                    if not part:
                        assert (t, a, b) not in got
                        continue
                    wanted += 1
                    r, v = got[t, a, b], np.array([x for x in part if x is not None])
                    assert (r.rows, r.n_v) == (len(part), len(v))
                    if len(v) > 2:
                        m = v - v.mean()
                        assert (r.mean_v, r.var_v, r.skew_v) == pytest.approx((v.mean(), v.var(ddof=1), (m**3).mean() / (m**2).mean() ** 1.5), rel=1e-6)
        assert len(got) == wanted
    assert slices.slice_grid(d.limit(0), ["v"], starts, stops, "t").count() == 0


def test_prefix_tree(spark):
    names = ["abc", "abd", "ab", "x", "yyyy1", "yyyy22", "yyyy23", "abc", None, ""]
    got = {(r.prefix, r.parent, r.name) for r in slices.prefix_tree(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {
        ("ab", "", None), ("yyyy", "", None), ("yyyy2", "yyyy", None), ("abc", "ab", "abc"), ("abd", "ab", "abd"), ("ab", "ab", "ab"), ("x", "", "x"), ("yyyy1", "yyyy", "yyyy1"),
        ("yyyy22", "yyyy2", "yyyy22"), ("yyyy23", "yyyy2", "yyyy23"), ("", "", ""),
    }


def test_sql_functions(spark):
    """Forms, scalars and gap filling by spark.sql alone."""
    sql.register(spark)
    spark.range(1, 9).createOrReplaceTempView("times")
    got = spark.sql("SELECT id, nn_form(id, 0.1) AS a, nn_form(id, 0.1, 1.5) AS b, rn_form(-id, 3.0, 0.2) AS c, rr_form(id, 0.3, 0.01, 0.05) AS d, exp_decay(t => id, sig => 2.0) AS e, chained_power(id, 1, 0.2, 0.5) AS g, powerlaw(id, 0.5, 2) AS p, decade(id * 37) AS x, distance_of(0, 0, id, 1) AS h, wrapped_angle(0.1, id, 4) AS w FROM times ORDER BY id")
    t = F.col("id").cast("double")
    parts = [forms.nn_form(t, 0.1), forms.nn_form(t, 0.1, 1.5), forms.rn_form(-t, 3.0, 0.2), forms.rr_form(t, 0.3, 0.01, 0.05), forms.exp_decay(t, 2.0), forms.chained_power(t, 1.0, 0.2, 0.5), forms.powerlaw(t, 0.5, 2.0), scalars.decade(t * 37), F.hypot(t, F.lit(1.0))]
    want = spark.range(1, 9).select("id", *[p.alias(f"c{k}") for k, p in enumerate(parts)]).orderBy("id").collect()
    for g, w in zip(got.collect(), want, strict=True):
        assert tuple(g)[:-1] == pytest.approx(tuple(w))
        assert abs(g.w) <= np.pi / 4 and np.isclose(np.cos(4 * g.w), np.cos(4 * (g.id - 0.1)))


def test_gaps_by_sql(spark):
    sql.register(spark)
    rng = np.random.default_rng(2)
    rows = [(t, int(f), float(rng.normal()) if rng.random() > 0.3 else None, f"n{f}") for t in range(4) for f in np.cumsum(rng.integers(1, 6, 40))]
    d = spark.createDataFrame(rows, "t long, f int, x double, name string")
    d.createOrReplaceTempView("gappy")
    got = spark.sql("SELECT * FROM fill_gaps(6, TABLE(gappy) PARTITION BY t ORDER BY f)")
    assert got.columns == ["t", "f", "x", "name", "is_filled"]
    # the ends stay as they are here, interpolate fills them
    inner = sequence.interpolate(sequence.densify(d), ["x"], 6)
    key = lambda r: (r.t, r.f)
    want = {key(r): r for r in inner.collect()}
    known = {t: [f for u, f, x, _ in rows if u == t and x is not None] for t in range(4)}
    mine = sorted(got.collect(), key=key)
    assert {key(r) for r in mine} == want.keys()
    for r in mine:
        w = want[key(r)]
        assert r.name == w.name
        if min(known[r.t]) <= r.f <= max(known[r.t]):
            assert r.x == (None if w.x is None else pytest.approx(w.x)), key(r)
