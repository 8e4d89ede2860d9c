"""Velocities, noise and diffusion constants of tracks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.operators.binning import bin_index
from pathfield.operators.groups import kurtosis_test, moments, skew_test, uneven_mean_weighted
from pathfield.operators.lag import field_autocorr
from pathfield.operators.scans import Scan
from pathfield.operators.sequence import gauss_filtered
from pathfield.operators.spatial import close_pairs

#: Velocity fields, as in schema.VELOCITY.
FIELDS = ["o", "v", "x", "y", "par", "perp", "eta", "etax", "etay", "etapar"]


def velocities(tracks: DataFrame, width: float = 0.65, side: float = 1.0, fps: float = 1.0) -> DataFrame:
    """(t, f, o, v, x, y, par, perp, etax, etay, eta, etapar): smoothed derivatives, along and across o, and what a track's mean speed leaves."""
    rows = gauss_filtered(tracks.select("t", "f", "x", "y", "o"), {f"__{c}": (c, width, 1) for c in "oxy"})
    rows = rows.select("t", "f", F.col("o").alias("a"), *[(F.col(f"__{c}") * s).alias(f"v{c}") for c, s in (("o", fps), ("x", fps / side), ("y", fps / side))])
    c, s = F.cos("a"), F.sin("a")
    rows = rows.withColumns({"par": F.col("vx") * c + F.col("vy") * s, "perp": F.col("vx") * s - F.col("vy") * c})
    rows = Scan(rows).add(__p=("total", F.col("par")), __n=("total", F.when(F.col("par").isNotNull(), 1))).done((F.col("__p") / F.col("__n")).alias("v0"))
    rows = rows.withColumns({"etax": F.col("vx") - F.col("v0") * c, "etay": F.col("vy") - F.col("v0") * s})
    return rows.select("t", "f", F.col("vo").alias("o"), F.hypot("vx", "vy").alias("v"), F.col("vx").alias("x"), F.col("vy").alias("y"), "par", "perp", "etax", "etay", F.hypot("etax", "etay").alias("eta"), (F.col("par") - F.col("v0")).alias("etapar"))


def vv_corr(tracks: DataFrame, fields: list[str] | None = None, max_lag: int | None = None, **kept) -> DataFrame:
    """(field, tau, mean, stderr, n): autocorrelation of the velocity fields about their means over tracks, long tracks weighing more."""
    return uneven_mean_weighted(field_autocorr(velocities(tracks, **kept), fields or FIELDS, max_lag), "c", ["field", "tau"], ["field", "t"])


def velocity_widths(tracks: DataFrame, widths: list[float], **kept) -> DataFrame:
    """(width, component, n, mean, d): diffusion constants by the width of the smoothing, for a few widths."""
    parts = [diffusion_from_velocity(velocities(tracks, w, **kept), w, kept.get("fps", 1.0)).select(F.lit(w).alias("width"), "component", "n", "mean", "d") for w in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def radial_vv(dots: DataFrame, bins: int, rmax: float, side: float = 1.0) -> DataFrame:
    """(bin, n, o, v, eta, xy): mean products of velocities (o, v, eta, and the dot product of vx, vy) of two dots of a frame against distance in sides."""
    p = close_pairs(dots, rmax * side, ["o", "v", "eta", "vx", "vy"], False, True)
    product = lambda c: F.col(f"{c}1") * F.col(f"{c}2")
    rows = p.withColumn("bin", bin_index(F.col("d") / side, 0.0, rmax, bins)).where("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(product(c)).alias(c) for c in ("o", "v", "eta")], F.avg(product("vx") + product("vy")).alias("xy"))


def velocity_stats(v: DataFrame, width: float = 0.65, fps: float = 1.0) -> DataFrame:
    """(component, n, mean, d, stderr, skew, kurtosis, skew_z, kurtosis_z): moments of the velocities about, across and along o, and the tests that they are normal."""
    dt = 2 * math.sqrt(3) * width / fps
    rows = moments(_components(v), "value", ["component"])
    n = F.col("n").cast("double")
    return rows.select("component", "n", "mean", (F.col("variance") * dt / 2).alias("d"), "stderr", "skew", "kurtosis", skew_test(n, F.col("skew")).alias("skew_z"), kurtosis_test(n, F.col("kurtosis")).alias("kurtosis_z"))


def _components(v: DataFrame) -> DataFrame:
    return v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in ("o", "perp", "par")])).alias("s")).select("s.*")


def diffusion_from_velocity(v: DataFrame, width: float = 0.65, fps: float = 1.0) -> DataFrame:
    """(component, n, mean, d): half the variance of the angular, across and along velocity times the filter's time."""
    return velocity_stats(v, width, fps).select("component", "n", "mean", "d")


def diffusion_from_msd(msd: DataFrame, low: int | str, high: int | str, by: list[str]) -> DataFrame:
    """d = mean of msd / (4 tau), weighted by 1 / tau, for lags low..high; 'min' stands for the lag with the least msd / tau."""
    rows = msd.where("tau >= 1").withColumn("__r", F.col("msd") / F.col("tau"))
    if "min" in (low, high):
        rows = rows.withColumn("__at", F.min(F.struct("__r", "tau")).over(Window.partitionBy(*by))["tau"])
    end = lambda x: F.col("__at") if x == "min" else F.lit(x)
    rows = rows.where(F.col("tau").between(end(low), end(high)))
    return rows.groupBy(*by).agg((F.sum(F.col("__r") / F.col("tau")) / F.sum(1 / F.col("tau")) / 4).alias("d"))


def power_law(msd: DataFrame, low: int, high: int, by: list[str]) -> DataFrame:
    """(by, d, b): msd = d tau^b, by the regression line of the logarithms over lags low..high."""
    rows = msd.where(F.col("tau").between(max(low, 1), high) & (F.col("msd") > 0)).withColumns({"lx": F.ln(F.col("tau").cast("double")), "ly": F.ln("msd")})
    return rows.groupBy(*by).agg(F.exp(F.regr_intercept("ly", "lx")).alias("d"), F.regr_slope("ly", "lx").alias("b"))


def ratio_with_error(a: DataFrame, b: DataFrame, on: list[str], value: str = "d", error: str = "stderr") -> DataFrame:
    """(on, ratio, stderr): a's value over b's, relative errors adding as squares."""
    x = a.select(*on, F.col(value).alias("va"), F.col(error).alias("ea"))
    y = b.select(*on, F.col(value).alias("vb"), F.col(error).alias("eb"))
    ratio = F.try_divide("va", "vb")
    return x.join(y, on).select(*on, ratio.alias("ratio"), (F.abs(ratio) * F.hypot(F.try_divide("ea", "va"), F.try_divide("eb", "vb"))).alias("stderr"))
