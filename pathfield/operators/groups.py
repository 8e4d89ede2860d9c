"""Operators on whole tracks or groups: filters, modes, moments, means of uneven series, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.operators.combine import joined_counts


def length_filter(tracks: DataFrame, least: int = 10, t: str = "t") -> DataFrame:
    """Rows of tracks with at least so many rows, or of the -least longest if that is negative; track -1 is none."""
    rows = tracks.where(F.col(t) >= 0)
    if least < 0:
        return rows.join(longest(tracks, -least, t).select(t), t, "left_semi")
    return joined_counts(rows, t, "__n").where(F.col("__n") >= least).drop("__n")


def longest(tracks: DataFrame, n: int, t: str = "t") -> DataFrame:
    """(t, n) of the longest tracks, ties to the smaller id."""
    return tracks.where(F.col(t) >= 0).groupBy(t).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), t).limit(n)


def modal_group_size(df: DataFrame, key: str) -> DataFrame:
    """The commonest number of rows of a group, ties to the smaller: (size, groups)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("groups"), "size").limit(1)


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, variance, standard error of the mean, skewness, excess kurtosis of each group."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), (F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).alias("stderr"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )


def skew_test(n, skew):
    """z of D'Agostino's test that a skewness is 0, as a Column; n >= 8."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    return F.when(n >= 8, delta * F.asinh(y / alpha))


def kurtosis_test(n, excess):
    """z of the Anscombe-Glynn test that an excess kurtosis is 0, as a Column; n >= 5."""
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - e) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    cube = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    term = F.signum(cube) * F.pow(F.abs(cube), F.lit(1 / 3))
    return F.when(n >= 5, (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a)))


def uneven_mean(series: DataFrame, value: str, at: str, least: int = 3) -> DataFrame:
    """Over series of different lengths: at each position mean, standard error and count, where at least so many have a value."""
    v = F.col(value)
    means = series.groupBy(at).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).alias("stderr"), F.count(v).alias("n"))
    return means.where(F.col("n") >= least)


def uneven_mean_weighted(series: DataFrame, value: str, at: str | list[str], key: str | list[str], least: int = 3) -> DataFrame:
    """As uneven_mean, each series weighted by the root of its number of values among the kept positions."""
    places, keys = ([k] if isinstance(k, str) else k for k in (at, key))
    rows = series.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *places]), F.col(value).alias("v"))
    kept = joined_counts(rows, places, "__n").where(F.col("__n") >= least).drop("__n")
    w = joined_counts(kept, keys, "__m").withColumn("w", F.sqrt(F.col("__m").cast("double")))
    sums = w.groupBy(*places).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"), F.count("v").alias("n"))
    mean = F.col("wv") / F.col("w")
    sd = F.sqrt(F.greatest(F.col("wvv") / F.col("w") - mean * mean, F.lit(0.0)))
    return sums.select(*places, mean.alias("mean"), (sd / F.sqrt(F.col("n").cast("double"))).alias("stderr"), "n")


def gap_distribution(tracks: DataFrame, t: str = "t", f: str = "f", field: str | None = None) -> DataFrame:
    """(gap, n): how often so many frames are missing between a track's neighbouring rows; field: rows where it is NULL count as missing."""
    rows = tracks if field is None else tracks.where(F.col(field).isNotNull())
    after = F.lead(f).over(Window.partitionBy(t).orderBy(f))
    gaps = rows.select(t, f).distinct().select((after - F.col(f) - 1).alias("gap"))
    return gaps.where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def merge(datasets: list[DataFrame], t: str = "t", dedupe: bool = False) -> DataFrame:
    """All rows of several datasets, each one's tracks numbered on from those before; a dataset column tells them apart. dedupe: equal rows of a dataset once."""
    out = None
    for k, d in enumerate(datasets):
        part = (d.distinct() if dedupe else d).withColumn("dataset", F.lit(k)).withColumn(t, F.col(t).cast("long"))
        out = part if out is None else out.unionByName(part)
    # tracks before each dataset's: a row a dataset, summed up over their list
    tops = out.groupBy("dataset").agg((F.coalesce(F.max(t), F.lit(-1)) + 1).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tops.select("dataset", before.alias("__before"))
    moved = out.join(F.broadcast(offsets), "dataset").withColumn(t, F.when(F.col(t) >= 0, F.col(t) + F.col("__before")).otherwise(F.col(t)))
    return moved.select(*out.columns)


def padded(series: DataFrame, value: str, n: int | None = None, t: str = "t", f: str = "f") -> DataFrame:
    """(t, values): each track's values by row as an array of n, NULLs behind its end; n: by default the longest track's rows, -1 the shortest's."""
    rows = series.groupBy(t).agg(F.sort_array(F.collect_list(F.struct(F.col(f).alias("f"), F.col(value).alias("v")))).alias("a"))
    if n is None or n < 0:
        rows = rows.join(F.broadcast(rows.agg((F.max if n is None else F.min)(F.size("a")).alias("n"))))
    else:
        rows = rows.withColumn("n", F.lit(n))
    return rows.select(t, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("a", i)["v"]).alias("values"))


def stacked(tracks: DataFrame, t: str = "t", f: str = "f") -> DataFrame:
    """tracks with row, the row's number in its track from 0, up to the shortest track's end: every row number has all tracks."""
    rows = joined_counts(tracks, t, "__n").withColumn("row", F.row_number().over(Window.partitionBy(t).orderBy(f)) - 1)
    least = tracks.groupBy(t).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__least"))
    return rows.join(F.broadcast(least)).where(F.col("row") < F.col("__least")).drop("__n", "__least")


def trial_median_mean(df: DataFrame, value: str, trial: str, f: str = "f") -> DataFrame:
    """Mean over trials of each frame's median, as long as the shortest trial lasts."""
    medians = df.groupBy(trial, f).agg(F.median(value).alias("m"))
    ends = medians.groupBy(trial).agg(F.max(f).alias("e")).agg(F.min("e").alias("e"))
    return medians.join(F.broadcast(ends), F.col(f) <= F.col("e")).groupBy(f).agg(F.avg("m").alias("mean"), F.count("m").alias("n"))


def radial_mean(curves: DataFrame, value: str, r: str, trial: str, normalised: bool = False, log: bool = False) -> DataFrame:
    """(r, mean, n): mean of a radial curve over trials, as far as the shortest trial reaches; each over its first value, or in logarithms, if asked for."""
    v = F.col(value)
    first = F.first(value).over(Window.partitionBy(trial).orderBy(r))
    v = F.try_divide(v, first) if normalised else v
    rows = curves.select(trial, r, (F.ln(v) if log else v).alias("v"))
    ends = rows.groupBy(trial).agg(F.max(r).alias("e")).agg(F.min("e").alias("e"))
    return rows.join(F.broadcast(ends)).where(F.col(r) <= F.col("e")).groupBy(r).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
