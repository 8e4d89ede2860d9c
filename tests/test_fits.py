"""Fits of many curves at once against a plain solver."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathfield.operators import fit
from pathfield.functions import forms


def solve(f, x, y, s, start, free, rounds=400):
    """Damped Gauss-Newton with central differences, a curve at a time."""
    p, damp = np.array(start, float), 1.0
    loss = lambda q: np.sum(((y - f(x, *q)) / s) ** 2)
    for _ in range(rounds):
        h = 1e-5 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(f(x, *(p + e * h)) - f(x, *(p - e * h))) / (2 * h[k]) / s for k, e in enumerate(np.eye(len(p))) if free[k]], 1)
        a, g = j.T @ j, j.T @ ((y - f(x, *p)) / s)
        q = p.copy()
        q[np.array(free)] += np.linalg.solve(a + damp * np.diag(np.diag(a)), g)
        p, damp = (q, damp / 2) if loss(q) <= loss(p) else (p, damp * 3)
    return p, np.sqrt(np.diag(np.linalg.inv(a)) * loss(p) / (len(x) - sum(free)))


CASES = {
    "exp_decay": (lambda t, sig, a, c: c + a * np.exp(-t / sig), [3.0, 2.0, 0.4], [1.0, 1.0, 0.0]),
    "rr": (lambda t, v0, dt, dr: 2 * (v0 / dr) ** 2 * (dr * t + np.expm1(-dr * t)) + 4 * dt * t, [0.4, 0.05, 0.2], [0.16, 0.01, 0.1]),
    "chained_power": (lambda t, d1, d2, b1: np.maximum(d1 * t**b1, d2 * t), [1.5, 0.5, 0.4], [1.0, 1.0, 1.0]),
}


@pytest.mark.parametrize("name", ["chained_power", "exp_decay", "rr"])
def test_many_curves(spark, name):
    """30 curves of their own parameters, some of few rows, one empty, one with NULLs: parameters and errors agree with the plain solver."""
    f, truth, start = CASES[name]
    rng = np.random.default_rng(9)
    x = np.linspace(0.5, 12, 80)
    curves = {f"c{k}": np.array(truth) * rng.uniform(0.8, 1.2, len(truth)) for k in range(30)}
    noise = {k: rng.normal(0, 0.01, len(x)) for k in curves}
    rows = [(k, float(v), float(y), 0.01) for k, p in curves.items() for v, y in zip(x, f(x, *p) + noise[k], strict=True)]
    rows += [("c0", None, 1.0, 0.01), ("c0", 1.0, None, 0.01), ("c0", 1.0, 9.0, 0.0), ("none", 1.0, None, 0.01)]
    got = fit.fit(spark.createDataFrame(rows, "k string, x double, y double, s double"), name, "k", "x", "y", "s", dict(zip(fit.FORMS[name][0], start, strict=True))).toPandas()
    wide, errors = (got.pivot(index="k", columns="param", values=v) for v in ("value", "stderr"))
    assert wide.loc["none"].to_dict() == dict(zip(fit.FORMS[name][0], start, strict=True))
    for k, p in list(curves.items())[:6]:
        best, error = solve(f, x, f(x, *p) + noise[k], 0.01, p, [True] * len(p))
        assert [wide.loc[k, n] for n in fit.FORMS[name][0]] == pytest.approx(best, rel=2e-4, abs=2e-4), k
        assert [errors.loc[k, n] for n in fit.FORMS[name][0]] == pytest.approx(error, rel=0.02), k


def test_bounds_fixed_and_given(spark):
    x = np.linspace(0, 5, 50)
    d = spark.createDataFrame([(k, float(v), float(s * v + 1)) for k, s in (("a", -1.0), ("b", 2.0)) for v in x], "k string, x double, y double")
    got = {(r.k, r.param): r for r in fit.fit(d, "line", "k", "x", "y", None, {"slope": 1.0, "c": 1.0}, ["c"], {"slope": 0.0}).collect()}
    assert got["a", "slope"].value == pytest.approx(0, abs=1e-6) and got["b", "slope"].value == pytest.approx(2) and got["b", "c"].stderr == 0
    given = spark.createDataFrame([("a", "c", 5.0)], "k string, param string, value double")
    got = {(r.k, r.param): r.value for r in fit.fit(d, "line", "k", "x", "y", None, {"slope": 1.0, "c": 1.0}, ["c"], None, given).collect()}
    assert got["a", "c"] == 5 and got["b", "c"] == 1 and got["a", "slope"] == pytest.approx(np.sum(x * (-x - 4)) / np.sum(x * x))
    assert fit.fit(d.limit(0), "line", "k", "x", "y", None, {"slope": 1.0, "c": 1.0}).count() == 0


def test_cage_decay_and_peaks(spark):
    t = np.arange(1, 200.0)
    rows = [(k, float(v), float(max(d1 * v**b1, d2 * v))) for k, d1, d2, b1 in (("a", 1.0, 0.1, 0.2), ("b", 2.0, 0.3, 0.4)) for v in t]
    got = {r.dataset: r.time for r in fit.cage_time(spark.createDataFrame(rows, "dataset string, tau double, msd double"), start={"d1": 1.0, "d2": 0.2, "b1": 0.3}).collect()}
    assert got["a"] == pytest.approx(10 ** (1 / 0.8), rel=1e-3) and got["b"] == pytest.approx((2 / 0.3) ** (1 / 0.6), rel=1e-3)
    x = np.linspace(0, 20, 100)
    d = spark.createDataFrame([(k, float(v), float(3 * math.exp(-v / s))) for k, s in (("a", 2.0), ("b", 7.0)) for v in x], "k string, x double, y double")
    assert {r.k: round(r.scale, 5) for r in fit.decay_fit(d, "x", "y", "k").collect()} == {"a": 2.0, "b": 7.0}
    r = np.arange(0, 12, 0.1)
    g = spark.createDataFrame([("a", float(v), float(1 + 2 * math.exp(-v / 4) * math.cos(2 * math.pi * v))) for v in r], "k string, r double, g double")
    got = {x.param: x.value for x in fit.peak_decay(g, "r", "g", "k").collect()}
    assert got["sig"] == pytest.approx(4, rel=0.03) and got["a"] == pytest.approx(2, rel=0.03) and got["c"] == pytest.approx(1, abs=0.03)


def test_modes_and_components(spark):
    """Curves of known parameters: every mode of the chain finds them."""
    lp, dr, dt = 3.0, 0.1, 0.05
    d = spark.range(-120, 121).select(F.lit("s").alias("dataset"), F.col("id").cast("double").alias("tau"), F.lit(0.01).alias("stderr"))
    at = F.abs("tau")
    curve = lambda c, two=False: d.where("true" if two else "tau >= 0").withColumn("mean", c)
    for components, modes in ((False, ("full", "max")), (True, ("anti",))):
        nn, rn = curve(forms.nn_form(at, dr, None, components)), curve(forms.rn_form(F.col("tau"), lp, dr, None, components), True)
        parts = {"prog": curve(forms.rr_form_prog(at, dt, lp, dr)), "div": curve(forms.rr_form_div(at, dt, lp, dr))}
        for mode in modes:
            got = {(r.func, r.param): r.value for r in fit.fit_chain(nn, rn, curve(forms.rr_form_total(at, dt, lp, dr)), dx=0.01, mode=mode, components=components, parts=parts if mode == "full" else None).collect()}
            name = {"full": "rn", "pos": "rp", "anti": "ra", "max": "rm"}[mode]
            # the largest value within three times 1 / dr lacks exp(-3) of lp
            want = lp * (1 - math.exp(-3)) if mode == "max" else lp
            assert got["nn", "dr"] == pytest.approx(dr, rel=1e-3) and got[name, "lp"] == pytest.approx(want, rel=1e-2)
            if mode == "full":
                assert [got[f, "dt"] for f in ("rr", "pr", "dr")] == pytest.approx([dt] * 3, rel=1e-2)


def test_regimes_and_shift(spark):
    row = spark.range(1).select(*[forms.rr_regimes(F.lit(t), 0.4, 0.01, 0.05).alias(f"t{k}") for k, t in enumerate((0.1, 0.25, 10.0, 40.0, 400.0))], forms.shift_power(F.lit(0.95), 1.0, 2.0, 1.0, dt=0.1).alias("s"), forms.critical_power(F.lit(3.0), 1.0, 2.0, 2.0, 1.0).alias("c")).first()
    assert tuple(row) == pytest.approx((0.004, 0.01, 16.0, 256.0, 2560.0, 20.0, 9.0))
