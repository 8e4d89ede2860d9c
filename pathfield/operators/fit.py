"""Least-squares fits of named forms to many curves at once.

A step of all fits is one aggregation: with each curve's parameters joined to its rows, the sums of squares and of products of slopes, the normal equations, are grouped sums of Column
expressions. What a step decides for a curve, from one row of sums, goes into a staged table, and curves that have settled take no part in the next one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.functions import forms
from pathfield.operators.graph import staged_and_seen
from pathfield.operators.simulate import hashed_normal, uniform

#: Share of the sum of squares that a step has to gain for the fit to go on.
GAIN = 1e-9

Form = tuple[Sequence[str], Callable[..., Column]]
#: Parameters of each form and the form, of x and the parameters as Columns.
FORMS: dict[str, Form] = {
    "line": (("slope", "c"), lambda x, slope, c: c + slope * x),
    "exp_decay": (("sig", "a", "c"), forms.exp_decay),
    "powerlaw": (("b", "a", "c"), forms.powerlaw),
    "chained_power": (("d1", "d2", "b1"), forms.chained_power),
    "critical_power": (("tc", "a", "b", "c"), forms.critical_power),
    "gauss": (("a", "x0", "sig", "c"), forms.gauss),
    "nn": (("dr",), forms.nn_form),
    "nn_colour": (("dr", "tr"), forms.nn_form),
    "nn_component": (("dr",), lambda t, dr: forms.nn_form(t, dr, None, True)),
    "rn": (("lp", "dr"), forms.rn_form),
    "rn_colour": (("lp", "dr", "tr"), forms.rn_form),
    "rn_component": (("lp", "dr"), lambda t, lp, dr: forms.rn_form(t, lp, dr, None, True)),
    "rr": (("v0", "dt", "dr"), forms.rr_form),
    "rr_total": (("dt", "lp", "dr"), forms.rr_form_total),
    "rr_total_colour": (("dt", "lp", "dr", "tr"), forms.rr_form_total),
    "rr_prog": (("dt", "lp", "dr"), forms.rr_form_prog),
    "rr_prog_colour": (("dt", "lp", "dr", "tr"), forms.rr_form_prog),
    "rr_div": (("dt", "lp", "dr"), forms.rr_form_div),
    "rr_div_colour": (("dt", "lp", "dr", "tr"), forms.rr_form_div),
}
#: Values that stand for parameters no fit has given yet.
GUESSES = {"tr": 1.6, "dr": 1 / 16, "lp": 2.5, "v0": 0.16, "dt": 0.01}
#: Fits in the order in which they are asked for a parameter.
SOURCES = ("nn", "rn", "ra", "rp", "rr", "r0", "pr", "p0", "dr", "d0")


def fit(curves: DataFrame, form: str | Form, by: str, x: str, y: str, sigma: str | None, start: dict[str, float], fixed: Sequence[str] = (), lows: dict[str, float] | None = None, given: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(by, param, value, stderr) of each curve, by damped Gauss-Newton steps with numeric slopes; errors are 0 where fixed.

    given: (by, param, value) that replace the start values of a curve. lows: least values. Rows without x, y or a sigma above 0 take no part (sigma None: all alike); a curve with none keeps its start
    values. A fit ends when a step lowers the sum of squares by less than GAIN of it or could not gain more, and after so many rounds; a parameter that the data do not bound goes on growing until then.
    """
    names, f = FORMS[form] if isinstance(form, str) else form
    free = [n for n in names if n not in fixed]
    rows = curves.select(F.col(by).alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), (F.col(sigma) if sigma else F.lit(1.0)).cast("double").alias("__s"))
    rows = staged(rows.where(F.col("__k").isNotNull()), "curves")
    begin = rows.select("__k").distinct()
    if given is not None:
        known = given.where(F.col("param").isin(list(names))).groupBy(F.col(by).alias("__k")).agg(*[F.max(F.when(F.col("param") == n, F.col("value"))).alias(f"g_{n}") for n in names])
        begin = begin.join(known, "__k", "left")
    value = lambda n: F.coalesce(F.col(f"g_{n}"), F.lit(float(start[n]))) if given is not None else F.lit(float(start[n]))
    empty = F.array().cast("array<double>")
    state = begin.select("__k", *[value(n).alias(c) for n in names for c in (f"p_{n}", f"q_{n}")], F.lit(math.inf).alias("loss"), F.lit(1e-3).alias("damp"), F.lit(0).cast("long").alias("n"), empty.alias("normal"), F.lit(len(free) > 0).alias("active"))
    state, seen_now = staged_and_seen(state, "fit", F.count_if("active").alias("active"))
    low = np.array([-np.inf if (lows or {}).get(n) is None else lows[n] for n in free])
    rows = rows.where("__x is not null and __y is not null and __s > 0")

    trial = {n: F.col(f"q_{n}") for n in names}
    slopes = []
    for n in free:
        h = 1e-6 * F.greatest(F.abs(trial[n]), F.lit(1e-3))
        slopes.append((f(F.col("__x"), *(trial | {n: trial[n] + h}).values()) - F.col("__f")) / h / F.col("__s"))
    m = len(free)
    sums = [F.sum(F.col("__r") * F.col("__r")).alias("l"), F.count("__r").alias("c"), F.sum(F.pow(F.col("__y") / F.col("__s"), 2)).alias("t")]
    sums += [F.sum(F.col(f"__j{a}") * F.col(f"__j{b}")).alias(f"a{a}_{b}") for a in range(m) for b in range(a, m)] + [F.sum(F.col(f"__j{a}") * F.col("__r")).alias(f"g{a}") for a in range(m)]

    def decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_step(r, free, low) for r in frame.to_dict("records")], columns=columns)

    columns = state.columns
    for _ in range(rounds):
        count = seen_now["active"]
        if not count:
            break
        active = state.where("active")
        held = F.broadcast(active) if count <= 100_000 else active
        at = rows.join(held.select("__k", *[f"q_{n}" for n in names]), "__k").withColumn("__f", f(F.col("__x"), *trial.values()))
        at = at.withColumn("__r", (F.col("__y") - F.col("__f")) / F.col("__s")).withColumns({f"__j{k}": c for k, c in enumerate(slopes)})
        seen = active.join(at.groupBy("__k").agg(*sums), "__k", "left")
        state, seen_now = staged_and_seen(state.where("not active").unionByName(seen.mapInPandas(decided, state.schema)), "fit", F.count_if("active").alias("active"))
    out = state.select(F.col("__k").alias(by), F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(f"p_{n}").alias("value"), _error(free.index(n), m) if n in free else F.lit(0.0).alias("stderr")) for n in names])).alias("s"))
    return out.select(by, "s.*")


def _error(k: int, m: int) -> Column:
    """A parameter's standard error, which the last step has left behind the normal equations."""
    return F.coalesce(F.get("normal", F.lit(m * m + m + k)), F.lit(0.0)).alias("stderr")


def _step(r: dict, free: Sequence[str], low: np.ndarray) -> dict:
    """A curve's state after the sums at its trial parameters: the trial is taken if it lowers the sum of squares, and a new one set."""
    m, kept = len(free), {k: v for k, v in r.items() if k not in ("l", "c", "t") and not (k[0] in "ag" and k[1:2].isdigit())}
    loss = r["l"] if r["c"] == r["c"] and r["c"] else math.nan
    p = np.array([r[f"p_{n}"] for n in free])
    normal = np.array(r["normal"], float)
    if math.isfinite(loss) and loss < r["loss"] or r["loss"] == math.inf and loss == loss:
        done = r["loss"] - loss < GAIN * r["loss"] if math.isfinite(r["loss"]) else False
        p = np.array([r[f"q_{n}"] for n in free])
        a = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                a[i, j] = a[j, i] = r[f"a{i}_{j}"]
        normal = np.concatenate([a.ravel(), [r[f"g{i}"] for i in range(m)]])
        if not np.isfinite(normal).all():
            return kept | {"active": False}
        error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)), 0) * loss / max(1, r["c"] - m))
        kept |= {f"p_{n}": v for n, v in zip(free, p.tolist(), strict=True)}
        kept |= {"loss": loss, "damp": r["damp"] / 5, "n": r["c"], "normal": np.concatenate([normal, error]).tolist(), "active": not done and loss > 1e-20 * r["t"]}
    else:
        kept |= {"damp": r["damp"] * 10, "active": r["damp"] < 1e8 and len(normal) > 0}
    if kept["active"]:
        a, g = np.array(kept["normal"])[: m * m].reshape(m, m), np.array(kept["normal"])[m * m : m * m + m]
        # what a step can gain at the most; one that a bound cuts short may gain nothing, a shorter one still does
        gain = 0.0
        while gain <= 0 and kept["damp"] < 1e8:
            step = np.linalg.lstsq(a + kept["damp"] * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
            q = np.maximum(p + step, low)
            gain = float(2 * (q - p) @ g - (q - p) @ a @ (q - p))
            kept["damp"] *= 1 if gain > 0 else 10
        kept |= {f"q_{n}": v for n, v in zip(free, q.tolist(), strict=True)}
        kept["active"] = gain > GAIN * kept["loss"]
    return kept


def sigma_for_fit(curve: DataFrame, x: str, y: str, error: str, const: float | None = None, relative: bool = False, power: float | str | None = None, ignore: Sequence[float] = ()) -> DataFrame:
    """curve with sigma, the uncertainty a fit takes: the error, over the value if relative, with a constant added as a square, times x^power or ln(1 + x) ('log').

    ignore: points left out instead of given endless uncertainty: 0 stands for the rows around x = 0, any other two for the range outside
    them, a single other one for what lies beyond it.
    """
    rows = curve
    others = sorted(v for v in ignore if v != 0)
    if 0 in ignore:
        rows = rows.where(F.abs(F.col(x)) >= 1e-12)
    if others:
        rows = rows.where(F.col(x) <= others[-1])
    if len(others) > 1:
        rows = rows.where(F.col(x) >= others[0])
    s = F.try_divide(F.col(error), F.abs(F.col(y))) if relative else F.col(error)
    if const is not None:
        s = F.hypot(s, F.lit(float(const)))
    if power is not None:
        s = s * (F.log1p(F.col(x)) if power == "log" else F.pow(F.col(x), F.lit(float(power))))
    return rows.withColumn("sigma", s)


def parameter(fits: DataFrame, name: str, by: str = "dataset", sources: Sequence[str] = SOURCES) -> DataFrame:
    """(by, param, value, source): of each dataset in fits (by, func, param, value) the parameter by the first function that has it, else the guess."""
    rank = F.array_position(F.lit(list(sources)), F.col("func"))
    found = fits.where((F.col("param") == name) & F.col("value").isNotNull()).withColumn("rank", rank).where("rank > 0")
    best = found.groupBy(by).agg(F.min_by(F.struct("value", F.col("func").alias("source")), "rank").alias("b"))
    rows = fits.select(by).distinct().join(best, by, "left")
    return rows.select(by, F.lit(name).alias("param"), F.coalesce("b.value", F.lit(GUESSES[name])).alias("value"), F.coalesce("b.source", F.lit("guess")).alias("source"))


def fit_chain(nn: DataFrame, rn: DataFrame, rr: DataFrame, by: str = "dataset", dtheta: float = 0.02, dx: float = 0.25, zoom: float = 1.0, mode: str = "full", colour: float | None = None, components: bool = False, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """(by, func, param, value, stderr): curves (by, tau, mean, stderr) fitted one after the other.

    The orientation correlation gives dr; the displacement along the orientation, with this dr, gives lp; the mean squared displacement,
    with both, gives dt. mode, of the second: 'full', 'pos' (tau > 0 alone), 'anti' (the antisymmetric part) or 'max' (lp is the largest value of that part). colour: correlation time of the
    turning noise; None for white noise. components: nn and rn are of one component of the orientation. parts: curves of the displacement along ('prog') and across ('div') the orientation, which
    give a dt of their own.
    """
    if mode not in ("full", "pos", "anti", "max"):
        raise ValueError(f"unknown mode: {mode}")
    if colour and components:
        raise ValueError("forms of components are for white noise")
    fixed, more = ({"tr": colour}, "_colour") if colour else ({}, "_component" if components else "")
    curve = lambda c: c.select(by, F.col("tau").cast("double").alias("tau"), "mean", "stderr")
    first = sigma_for_fit(curve(nn), "tau", "mean", "stderr", dtheta / math.sqrt(2), ignore=[0, 50 * zoom])
    a = staged(fit(first, "nn" + more, by, "tau", "mean", "sigma", {**GUESSES, **fixed}, [*fixed], {"dr": 0.0}), "fit")
    rows = curve(rn)
    if mode in ("anti", "max"):
        back = rows.select(by, (-F.col("tau")).alias("tau"), F.col("mean").alias("m2"), F.col("stderr").alias("s2"))
        rows = rows.join(back, [by, "tau"]).select(by, "tau", ((F.col("mean") - F.col("m2")) / 2).alias("mean"), (F.hypot("stderr", "s2") / 2).alias("stderr"))
    known = a.where("param = 'dr'")
    reach = known.select(by, F.try_divide(F.lit(3 * zoom), F.col("value")).alias("reach"), F.col("value").alias("dr"))
    rows = rows.join(reach, by).where((F.abs("tau") <= F.col("reach")) & ((F.col("tau") > 0) if mode == "pos" else F.lit(True)))
    if mode == "max":
        top = F.max("mean") / (F.exp(F.max("dr") * colour) if colour else 1.0) * (2 if components else 1)
        b = staged(rows.groupBy(by).agg(top.alias("value"), F.max_by("stderr", "mean").alias("stderr")).select(by, F.lit("lp").alias("param"), "value", "stderr"), "fit")
    else:
        second = sigma_for_fit(rows, "tau", "mean", "stderr", math.hypot(dtheta, dx) / math.sqrt(2), ignore=[0])
        b = staged(fit(second, "rn" + more, by, "tau", "mean", "sigma", {**GUESSES, **fixed}, ["dr", *fixed], {"lp": 0.0}, known.select(by, "param", "value")), "fit")
    both = known.unionByName(b.where("param = 'lp'")).select(by, "param", "value")

    def third(c: DataFrame, form: str) -> DataFrame:
        s = sigma_for_fit(curve(c), "tau", "mean", "stderr", math.sqrt(2) * dx, power=1, ignore=[0, 200 * zoom])
        return fit(s, form + ("_colour" if colour else ""), by, "tau", "mean", "sigma", {**GUESSES, **fixed}, ["dr", "lp", *fixed], {"dt": 0.0}, both)

    name = {"full": "rn", "pos": "rp", "anti": "ra", "max": "rm"}[mode]
    found = [(a, "nn"), (b, name), (third(rr, "rr_total"), "rr"), *[(third(c, f"rr_{k}"), {"prog": "pr", "div": "dr"}[k]) for k, c in (parts or {}).items()]]
    out = None
    for t, n in found:
        t = t.select(by, F.lit(n).alias("func"), "param", "value", "stderr")
        out = t if out is None else out.unionByName(t)
    return out


def cage_time(msds: DataFrame, by: str = "dataset", sigma: str | None = None, start: dict[str, float] | None = None) -> DataFrame:
    """(by, d1, d2, b1, time): a power law b1 and a straight line d2 tau, the larger of which is the squared displacement (by, tau, msd), and the lag at which they cross; NULL if they don't.

    start: of the fit, by default 1 for all three.
    """
    rows = msds.where("tau > 0")
    found = fit(rows, "chained_power", by, "tau", "msd", sigma, start or {"d1": 1.0, "d2": 1.0, "b1": 1.0}, lows={"d1": 0.0, "d2": 0.0})
    wide = found.groupBy(by).agg(*[F.max(F.when(F.col("param") == n, F.col("value"))).alias(n) for n in ("d1", "d2", "b1")])
    crossed = (F.col("d1") > 0) & (F.col("d2") > 0) & (F.col("b1") != 1)
    return wide.withColumn("time", F.when(crossed, F.pow(F.col("d1") / F.col("d2"), 1 / (1 - F.col("b1")))))


def decay_fit(curves: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, scale, stderr): the length of an exponential decay without an offset, fitted to each curve's values."""
    form: Form = (("sig", "a"), forms.exp_decay)
    first = curves.where(F.col(y) > 0).groupBy(by).agg(F.min_by(y, x).alias("a"), F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(y)).alias("sig")).where("sig > 0")
    given = first.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).cast("double").alias("value")) for n in ("sig", "a")])).alias("s")).select(by, "s.*")
    found = fit(curves, form, by, x, y, None, {"sig": 1.0, "a": 1.0}, (), {"sig": 1e-9}, given)
    return found.where("param = 'sig'").select(by, F.col("value").alias("scale"), "stderr")


def peak_decay(curves: DataFrame, r: str, g: str, by: str, form: str = "exp_decay", lookahead: int = 2, start: dict[str, float] | None = None) -> DataFrame:
    """(by, param, value, stderr): a decay through the maxima of a pair distribution, 'exp_decay' or 'powerlaw'. start: of all fits, by default from each curve's maxima. Curves with fewer maxima than parameters are left out."""
    from pathfield.operators.sequence import peaks

    tops = peaks(curves.select(by, r, g), r, g, [by], lookahead).where("kind = 'max'")
    enough = tops.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= len(FORMS[form][0]))
    tops = staged(tops.join(enough, by, "left_semi").select(by, r, g), "tops")
    # from the peaks' own extent and heights
    first = tops.groupBy(by).agg(((F.max(r) - F.min(r)) / 2).alias("sig"), (F.max(g) - F.min(g)).alias("a"), F.min(g).alias("c"))
    given = first.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).cast("double").alias("value")) for n in ("sig", "a", "c")])).alias("s")).select(by, "s.*")
    return fit(tops, form, by, r, g, None, start or {"sig": 1.0, "b": 1.0, "a": 1.0, "c": 0.0}, given=None if start else given)


def primary_angles(angles: DataFrame, o: str, m: int = 4, bins: int = 720, by: str = "dataset") -> DataFrame:
    """(by, param, value, stderr): the m directions a0.. that angles gather about, from von Mises peaks (place a, sharpness k, height w) and a constant c fitted to the angles' density. Zeros don't count."""
    turn = F.pmod(F.col(o), F.lit(2 * math.pi))
    counts = angles.where(F.col(o) != 0).select(by, F.least(F.floor(turn / (2 * math.pi / bins)), F.lit(bins - 1)).alias("bin")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    all_of = counts.groupBy(by).agg(F.sum("n").alias("all"))
    grid = all_of.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = grid.join(counts, [by, "bin"], "left").fillna(0, ["n"])
    rows = counts.select(by, ((F.col("bin") + 0.5) * (2 * math.pi / bins)).alias("x"), (F.col("n") / F.col("all") / (2 * math.pi / bins)).alias("y"))
    top = rows.groupBy(by).agg(F.max_by("x", "y").alias("top"), F.max("y").alias("height"))
    places = [F.struct(F.lit(f"a{k}").alias("param"), F.pmod(F.col("top") + 2 * math.pi * k / m, F.lit(2 * math.pi)).alias("value")) for k in range(m)]
    heights = [F.struct(F.lit(f"w{k}").alias("param"), F.col("height").alias("value")) for k in range(m)]
    start = top.select(by, F.explode(F.array(*places, *heights)).alias("s")).select(by, "s.*")
    names = [*(f"a{k}" for k in range(m)), *(f"k{k}" for k in range(m)), *(f"w{k}" for k in range(m)), "c"]

    def density(x: Column, *p: Column) -> Column:
        out = p[-1]
        for k in range(m):
            out = out + p[2 * m + k] * F.exp(p[m + k] * (F.cos(x - p[k]) - 1))
        return out

    begin = {n: 100.0 if n[0] == "k" else 1e-3 for n in names}
    return fit(rows, (names, density), by, "x", "y", None, begin, (), {n: 1e-6 for n in names if n[0] == "k"}, start)


def parabola_peak(curve: DataFrame, x: str, y: str, x0: float, width: float, by: str = "dataset") -> DataFrame:
    """(by, at, height): top of the parabola through a curve's points within half a width of x0, in closed form."""
    rows = curve.where(F.abs(F.col(x) - x0) <= width / 2).select(by, (F.col(x) - x0).alias("u"), F.col(y).alias("v"))
    s = lambda p, v=False: F.sum(F.pow("u", F.lit(float(p))) * (F.col("v") if v else 1))
    g = rows.groupBy(by).agg(F.count("v").cast("double").alias("s0"), *[s(p).alias(f"s{p}") for p in (1, 2, 3, 4)], *[s(p, True).alias(f"t{p}") for p in (0, 1, 2)])
    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    det = lambda a: a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
    m = [c[f"s{i + j}"] for i in range(3) for j in range(3)]
    t = [c["t0"], c["t1"], c["t2"]]
    solved = [F.try_divide(det([t[i] if j == k else m[3 * i + j] for i in range(3) for j in range(3)]), det(m)) for k in range(3)]
    g = g.select(by, *[v.alias(f"c{k}") for k, v in enumerate(solved)])
    return g.select(by, (x0 - F.try_divide(F.col("c1"), 2 * F.col("c2"))).alias("at"), (F.col("c0") - F.try_divide(F.col("c1") * F.col("c1"), 4 * F.col("c2"))).alias("height"))


def propagated(spark: SparkSession, kind: str, errors: tuple[float, float], size: int = 100_000, span: tuple[float, float] = (2 * math.pi, 10.0), seed: int = 1) -> DataFrame:
    """(predicted, sampled): error of a product by the rule of squares and by sampling, for 'nn' (cos a cos b), 'rn' (cos a x) or 'rr' (x y).

    Values are uniform over the spans, errors normal; both hashed from the row's number, so the sample is the same wherever it is drawn.
    """
    rows = spark.range(size)
    u = [uniform(F.col("id"), seed, k) * span[0 if kind == "nn" else 1 if kind == "rr" else k] for k in (0, 1)]
    e = [(errors[0] if kind != "rn" or k == 0 else errors[1]) * hashed_normal(F.col("id"), F.lit(seed), k + 2) for k in (0, 1)]
    f = {"nn": lambda a, b: F.cos(a) * F.cos(b), "rn": lambda a, b: F.cos(a) * b, "rr": lambda a, b: a * b}[kind]
    rows = rows.select(u[0].alias("a"), u[1].alias("b"), e[0].alias("ea"), e[1].alias("eb"))
    a, b = F.col("a"), F.col("b")
    size_of = {"nn": F.lit(errors[0] / math.sqrt(2)), "rn": F.avg(F.sqrt(errors[1] ** 2 + F.pow(b * errors[0], 2))) / math.sqrt(2), "rr": math.sqrt(2) * errors[0] * F.sqrt(F.avg(a * a))}[kind]
    return rows.agg(size_of.alias("predicted"), F.stddev_pop(f(a + F.col("ea"), b + F.col("eb")) - f(a, b)).alias("sampled"))
