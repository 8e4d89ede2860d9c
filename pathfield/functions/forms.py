"""Functional forms as Column expressions; parameters are numbers or Columns. Without a colour (tr) the noise is white."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def exp_decay(t: Column, sig=1.0, a=1.0, c=0.0) -> Column:
    return c + a * F.exp(-t / sig)


def log_decay(t: Column, a=1.0, tl=1.0, c=0.0) -> Column:
    return c - a * F.ln(t / tl)


def powerlaw(t: Column, b=1.0, a=1.0, c=0.0) -> Column:
    """c + a / t^b."""
    return c + a * F.pow(t, F.lit(-b))


def chained_power(t: Column, d1, d2, b1, b2=1.0, c1=0.0, c2=0.0) -> Column:
    """The larger of two growing power laws."""
    return F.greatest(c1 + d1 * F.pow(t, F.lit(b1)), c2 + d2 * F.pow(t, F.lit(b2)))


def crossover(d1: float, d2: float, b1: float, b2: float) -> float:
    """Where two power laws meet."""
    return (d1 / d2) ** (1 / (b2 - b1))


def gauss(x: Column, a=1.0, x0=0.0, sig=1.0, c=0.0) -> Column:
    """c + a exp(-((x - x0) / sig)^2)."""
    return c + a * F.exp(-F.pow((x - x0) / sig, F.lit(2.0)))


def poly_exp(x: Column, gamma: float, a: float, *c: float) -> Column:
    """a exp(-x^gamma / (c0 + c1 x + ...))."""
    poly = sum((k * F.pow(x, F.lit(float(i))) for i, k in enumerate(c)), F.lit(0.0))
    return a * F.exp(-F.pow(x, F.lit(gamma)) / poly)


def shift_power(t: Column, tc=0.0, a=1.0, b=1.0, c=0.0, dt: float | None = None) -> Column:
    """c + a / (tc - t)^b before tc. dt: the spacing of t, at which values within dt of tc stop growing; without it they have no bound."""
    before = tc - t if dt is None else F.greatest(tc - t, F.lit(dt))
    return F.when(t < tc, c + a * F.pow(before, F.lit(-b)))


def critical_power(t: Column, tc=0.0, a=1.0, b=1.0, c=0.0) -> Column:
    """c + a |tc - t|^b on either side of a critical value."""
    return c + a * F.pow(F.abs(tc - t), F.lit(b))


def _turned(t: Column, dr, tr) -> Column:
    """Mean square turn, halved, after a time; coloured noise begins to turn after its own time."""
    return dr * t if tr is None else dr * (t + tr * F.expm1(-t / tr))


def nn_form(t: Column, dr, tr=None, components: bool = False) -> Column:
    """Orientation correlation of a rotating walker; of one component of the orientation, half of it."""
    return (0.5 if components else 1.0) * F.exp(-_turned(t, dr, tr))


def rn_form(t: Column, lp, dr, tr=None, components: bool = False) -> Column:
    """Displacement along the first orientation; odd in t."""
    way = F.signum(t) * -F.expm1(-dr * F.abs(t))
    return (0.5 if components else 1.0) * lp * way * (1.0 if tr is None else F.exp(F.lit(dr * tr)))


def rr_form(t: Column, v0, dt, dr) -> Column:
    """Mean squared displacement of an active walker in the plane."""
    return 2 * (v0 / dr) * (v0 / dr) * (dr * t + F.expm1(-dr * t)) + 4 * dt * t


def rr_share(s: Column, dt, lp, dr, tr=None, along: int = 0) -> Column:
    """Mean squared displacement in one direction: along (1) or across (-1) the first orientation, or half of both (0).

    Swimming straight for lp spreads as much over both, but for what the second harmonic of the turn, which fades four times as fast, has not yet evened out.
    """
    turn = dr * s
    spread = F.expm1(-turn) + turn
    colour = 1.0 if tr is None else F.exp(F.lit(dr * tr))
    uneven = (F.expm1(-4 * turn) - 4 * F.expm1(-turn)) / 12 * F.pow(F.lit(colour), F.lit(4.0)) if along else F.lit(0.0)
    return colour * lp * lp * (spread + along * uneven) + 2 * dt * s


def rr_form_prog(s: Column, dt, lp, dr, tr=None) -> Column:
    """Mean squared displacement along the first orientation."""
    return rr_share(s, dt, lp, dr, tr, 1)


def rr_form_div(s: Column, dt, lp, dr, tr=None) -> Column:
    """Mean squared displacement across the first orientation."""
    return rr_share(s, dt, lp, dr, tr, -1)


def rr_form_total(s: Column, dt, lp, dr, tr=None) -> Column:
    """Sum of both."""
    return 2 * rr_share(s, dt, lp, dr, tr)


def rr_regimes(t: Column, v0, dt, dr) -> Column:
    """Limits of rr_form: 4 dt t up to 4 dt / v0^2, v0^2 t^2 up to 2 / dr, and from there 2 v0^2 / dr t, each beginning where it overtakes the one before.

    The borders are where neighbouring limits of this form meet, so the guide has no jumps.
    """
    early, late = 4 * dt / (v0 * v0), 2 / dr
    return F.when(t < early, 4 * dt * t).when(t < late, v0 * v0 * t * t).otherwise(2 * v0 * v0 / dr * t)


def kernel_moment(kernel: Column, n: int) -> Column:
    """Sum of k_i i^n over an array, i from the middle."""
    mid = (F.size(kernel) - 1) / 2
    terms = F.transform(kernel, lambda k, i: k * F.pow(i - mid, F.lit(float(n))))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
