"""Ordered operators within tracks, by running values that cut large tracks into pieces (`scans`); Columns that a caller puts into a select are plain windows over (t, f)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.operators.scans import LARGE, Scan, halo


def _by(t: str, f: str):
    return Window.partitionBy(t).orderBy(f)


def unwrap(tracks: DataFrame, o: str = "o", t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """Angles without jumps of more than pi between a track's neighbouring known values; NULLs stay."""
    scan = Scan(tracks, t, f, large).add(__before=("before", F.col(o)))
    step = F.col(o) - F.col("__before.v")
    scan.with_columns(__turn=F.when(F.abs(step) > math.pi, F.signum(step)).otherwise(0.0)).add(__turns=("sum", F.coalesce("__turn", F.lit(0.0))))
    return scan.with_columns(**{o: F.col(o) - 2 * math.pi * F.col("__turns")}).done()


def dedupe(tracks: DataFrame, ties: str = "first", t: str = "t", f: str = "f", x: str = "x", y: str = "y", key: str = "id") -> DataFrame:
    """Of a track's rows in one frame, the one nearest to its rows in the frames before and after.

    The score is the sum of squared distances to the mean places of the neighbouring frames the track has (a frame with one row
    is that row). ties: 'first' keeps the smallest key, 'keep' all of them.
    """
    places = tracks.groupBy(t, f).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    w = _by(t, f)
    near = places.select(t, f, *[g(c).over(w).alias(f"{c}{n}") for n, g in (("_p", F.lag), ("_n", F.lead)) for c in ("__mx", "__my")])
    square = lambda n: F.coalesce(F.pow(F.col(x) - F.col(f"__mx{n}"), 2) + F.pow(F.col(y) - F.col(f"__my{n}"), 2), F.lit(0.0))
    scored = tracks.join(near, [t, f]).withColumn("__s", F.round(square("_p") + square("_n"), 9))
    order = Window.partitionBy(t, f).orderBy("__s", *([key] if ties == "first" else []))
    rank = F.row_number() if ties == "first" else F.rank()
    return scored.withColumn("__k", rank.over(order)).where("__k = 1").select(*tracks.columns)


def densify(tracks: DataFrame, t: str = "t", f: str = "f", drop_over: int | None = None, large: int | None = LARGE) -> DataFrame:
    """One row for every frame between a track's first and last; added rows have NULLs and is_filled.

    drop_over: tracks with a longer gap are left out.
    """
    scan = Scan(tracks, t, f, large).add(__next=("lead", F.col(f))).with_columns(__gap=F.coalesce(F.col("__next.f") - F.col(f) - 1, F.lit(0)))
    if drop_over is not None:
        scan.add(__most=("top", F.col("__gap")))
        scan.df = scan.df.where(F.col("__most") <= drop_over)
    rows = scan.done("__gap").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__gap").cast("int"))))
    own = F.col("__i") == 0
    keep = [F.col(c) if c == t else (F.col(f) + F.col("__i")).cast("int").alias(f) if c == f else F.when(own, F.col(c)).alias(c) for c in tracks.columns]
    return rows.select(*keep, (~own).alias("is_filled"))


def interpolate(tracks: DataFrame, columns: list[str], most: int = 10, t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """NULL runs of at most so many frames become straight lines; at a track's ends the nearest value.

    The known values before and after come from two running values, one from the end, so the work grows with a track's rows.
    """
    ends = {"__lo": ("top", -F.col(f)), "__hi": ("top", F.col(f))}
    known = {f"__{n}{k}": (kind, F.col(c)) for k, c in enumerate(columns) for n, kind in (("a", "last"), ("b", "next"))}
    scan = Scan(tracks, t, f, large).add(**ends, **known)
    filled = {}
    for k, c in enumerate(columns):
        a, b = F.col(f"__a{k}"), F.col(f"__b{k}")
        run = F.coalesce(b["f"], F.col("__hi") + 1) - F.coalesce(a["f"], -F.col("__lo") - 1) - 1
        line = a["v"] + (b["v"] - a["v"]) * F.try_divide((F.col(f) - a["f"]).cast("double"), (b["f"] - a["f"]).cast("double"))
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(run <= most, F.coalesce(line, a["v"], b["v"]))
    return scan.with_columns(**filled).done()


def repair(tracks: DataFrame, columns: list[str], most: int = 10, t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """densify, then interpolate."""
    return interpolate(densify(tracks, t, f, large=large), columns, most, t, f, large)


def differenced(tracks: DataFrame, name: str, c: str, central: bool = False, t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """tracks with the step to the next row (the last row repeats the step before), or central differences by rows, one-sided at the ends."""
    scan = Scan(tracks, t, f, large).add(__p=("lag", F.col(c)), __q=("lead", F.col(c)))
    before, after = F.col("__p.v"), F.col("__q.v")
    step = F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before) if central else F.coalesce(after - F.col(c), F.col(c) - before)
    return scan.with_columns(**{name: step}).done(*([] if name in tracks.columns else [name]))


def forward_difference(tracks: DataFrame, c: str, t: str = "t", f: str = "f") -> Column:
    """Step to the next row; the last row repeats the step before."""
    w = _by(t, f)
    return F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w))


def gradient(c: str, t: str = "t", f: str = "f") -> Column:
    """Central difference by rows, one-sided at the ends."""
    w = _by(t, f)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before)


def gauss_weights(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian (order 0) or its derivative (1) at -R..R, R = int(truncate sigma + 1/2)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    return w if order == 0 else [x * k / (sigma * sigma) for k, x in zip(range(-r, r + 1), w, strict=True)]


def gauss_filter(c: str, sigma: float = 0.65, order: int = 1, t: str = "t", f: str = "f") -> Column:
    """Smoothed value or derivative by rows; beyond the ends the end values count on."""
    w, whole = _by(t, f), Window.partitionBy(t).orderBy(f).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _weighted(c, gauss_weights(sigma, order), w, F.first(c).over(whole), F.last(c).over(whole), F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(t)))


def _weighted(c: str, weights: list[float], w, first: Column, last: Column, row: Column, n: Column) -> Column:
    # presence decides at the ends, so a NULL inside stays one
    r = len(weights) // 2
    terms = []
    for k, x in zip(range(-r, r + 1), weights, strict=True):
        value = F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
        terms.append(x * F.when(row + k < 1, first).when(row + k > n, last).otherwise(value))
    return sum(terms[1:], terms[0])


def gauss_filtered(tracks: DataFrame, what: dict[str, tuple[str, float, int]], t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """tracks with columns by name: (column, sigma, order) as in gauss_filter, in one pass. Groups of a cut track hold the rows that the filter reaches on either side."""
    weights = {k: gauss_weights(sigma, order) for k, (_, sigma, order) in what.items()}
    rows, keys = halo(tracks, max(len(w) // 2 for w in weights.values()), t, f, large)
    w, inside = Window.partitionBy(*keys).orderBy("__row"), Window.partitionBy(*keys)
    # the end values are in the groups that need them, as row 1 and row n
    end = lambda c, at: F.max(F.when(F.col("__row") == at, F.col(c))).over(inside)
    made = {k: _weighted(c, weights[k], w, end(c, F.lit(1)), end(c, F.col("__n")), F.col("__row"), F.col("__n")) for k, (c, *_) in what.items()}
    return rows.withColumns(made).where("__own").select(*tracks.columns, *[k for k in what if k not in tracks.columns])


def log_slope(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope of ln y over ln x between neighbouring rows, at their middle."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.col(x).alias("a"), F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    w = Window.partitionBy(*by).orderBy("a")
    rows = rows.select(*by, ((F.col("a") + F.lead("a").over(w)) / 2).alias("mid"), F.try_divide(F.lead("ly").over(w) - F.col("ly"), F.lead("lx").over(w) - F.col("lx")).alias("slope"))
    return rows.where("mid is not null")


def cumulative_trapezoid(df: DataFrame, y: str, x: str, t: str, name: str = "area", large: int | None = LARGE) -> DataFrame:
    """df with the area under y over x, by trapezoids, from each group's first row to each row."""
    scan = Scan(df, t, x, large).add(__p=("lag", F.col(y)))
    part = F.coalesce((F.col(x) - F.col("__p.f")) * (F.col(y) + F.col("__p.v")) / 2, F.lit(0.0))
    return scan.with_columns(__part=part).add(__area=("sum", F.col("__part"))).with_columns(**{name: F.col("__area")}).done(name)


def limited_means(series: DataFrame, c: str, t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """(t, lag, head, tail): means of the first and of the last L - lag values of each series."""
    one, known = F.lit(1), F.when(F.col(c).isNotNull(), 1)
    scan = Scan(series.select(t, f, c), t, f, large).add(
        i=("sum", one), j=("sum_back", one), n=("total", one), __a=("sum", F.col(c)), __m=("sum", known), __b=("sum_back", F.col(c)), __k=("sum_back", known)
    )
    rows = scan.df
    heads = rows.select(t, (F.col("n") - F.col("i")).alias("lag"), (F.col("__a") / F.col("__m")).alias("head"))
    tails = rows.select(t, (F.col("n") - F.col("j")).alias("lag"), (F.col("__b") / F.col("__k")).alias("tail"))
    return heads.join(tails, [t, "lag"])


def running_extrema_start(series: DataFrame, c: str, t: str, f: str, bounds: tuple[int | None, int | None] = (None, None), large: int | None = LARGE) -> DataFrame:
    """(t, start): the first frame, within [low, high) if given, whose running maximum so far equals the running minimum from there on; NULL if none."""
    rows = Scan(series.select(t, f, c), t, f, large).add(top=("max", F.col(c)), low=("min_back", F.col(c))).df
    inside = (F.col(f) >= bounds[0] if bounds[0] is not None else F.lit(True)) & (F.col(f) < bounds[1] if bounds[1] is not None else F.lit(True))
    return rows.groupBy(t).agg(F.min(F.when((F.col("top") == F.col("low")) & inside, F.col(f))).alias("start"))


def displaced(tracks: DataFrame, t: str = "t", f: str = "f", large: int | None = LARGE) -> DataFrame:
    """tracks with dx, dy: the way from each track's first place."""
    scan = Scan(tracks, t, f, large).add(__x=("first", F.col("x")), __y=("first", F.col("y")))
    return scan.with_columns(dx=F.col("x") - F.col("__x.v"), dy=F.col("y") - F.col("__y.v")).done("dx", "dy")


def motion_onset(tracks: DataFrame, bounds: tuple[int | None, int | None] = (None, None), dataset: str = "dataset") -> DataFrame:
    """(dataset, start): the frame before the one at which a dataset's motion, mean displacement times mean step, stops falling back.

    Only frames in which every track of the dataset has a row count, up to the first that some track lacks. Steps are central differences.
    """
    moved = displaced(tracks).withColumns({"__step": F.hypot(gradient("x"), gradient("y"))})
    frames = moved.groupBy(dataset, "f").agg((F.avg(F.hypot("dx", "dy")) * F.avg("__step")).alias("s"), F.count_distinct("t").alias("n"))
    tracks_of = tracks.groupBy(dataset).agg(F.count_distinct("t").alias("members"))
    frames = frames.join(tracks_of, dataset)
    short = frames.groupBy(dataset).agg(F.min(F.when(F.col("n") < F.col("members"), F.col("f"))).alias("end"))
    frames = frames.join(short, dataset).where((F.col("n") == F.col("members")) & (F.col("end").isNull() | (F.col("f") < F.col("end"))))
    return running_extrema_start(frames, "s", dataset, "f", bounds).select(dataset, (F.col("start") - 1).alias("start"))


def variable_smooth(series: DataFrame, c: str, width: Column, t: str = "t", f: str = "f") -> DataFrame:
    """series with c smoothed by a Gaussian whose width is a Column of the row: weights exp(-(k / s)^2) over the rows k = -w .. w, w = round(2 s).

    Rows beyond the ends are left out of sum and weights. Each row meets its own neighbours in one equi-join on (t, row number).
    """
    rows = series.withColumns({"__i": F.row_number().over(_by(t, f)), "__s": width.cast("double")})
    reach = F.rint(2 * F.col("__s")).cast("int")
    left = rows.select(t, "__i", F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")).alias("__s"), F.explode(F.sequence(-reach, reach)).alias("__k"))
    left = left.withColumn("__j", F.col("__i") + F.col("__k"))
    right = rows.select(t, F.col("__i").alias("__j"), F.col(c).alias("__v"))
    weight = F.exp(-F.pow(F.col("__k") / F.col("__s"), 2))
    sums = left.join(right, [t, "__j"]).groupBy(t, "__i").agg((F.sum(weight * F.col("__v")) / F.sum(F.when(F.col("__v").isNotNull(), weight))).alias("__v"))
    return rows.join(sums, [t, "__i"], "left").withColumn(c, F.col("__v")).select(*series.columns)


def is_sorted(df: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """(by, sorted): whether a value never falls along a group's order."""
    step = F.col(value) >= F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.select(by, F.coalesce(step, F.lit(True)).alias("__ok")).groupBy(by).agg(F.bool_and("__ok").alias("sorted"))


def every_kth(df: DataFrame, k: int, by: list[str] | None = None, f: str = "f") -> DataFrame:
    """Rows of every k-th frame, counted from the first of all or of each group."""
    first = df.groupBy(*(by or [])).agg(F.min(f).alias("__first"))
    rows = df.join(first, by) if by else df.join(F.broadcast(first))
    return rows.where((F.col(f) - F.col("__first")) % k == 0).drop("__first")


def truncated(tracks: DataFrame, n: int, t: str = "t", f: str = "f") -> DataFrame:
    """The first n rows of each track."""
    return Scan(tracks, t, f).add(__i=("sum", F.lit(1))).done("__i").where(F.col("__i") <= n).drop("__i")


def rezero(tracks: DataFrame, by: str, f: str = "f", backwards: bool = False) -> DataFrame:
    """Frames counted from each group's first, or backwards from its last."""
    ends = tracks.groupBy(by).agg((F.max(f) if backwards else F.min(f)).alias("__e"))
    return tracks.join(ends, by).withColumn(f, F.col("__e") - F.col(f) if backwards else F.col(f) - F.col("__e")).drop("__e")


def peaks(df: DataFrame, x: str, y: str, by: list[str], lookahead: int = 1, delta: float = 0.0) -> DataFrame:
    """Rows above all of the `lookahead` rows on either side (kind max), or below them (min), and by at least delta apart from the farthest.

    A row needs that many neighbours on both sides.
    """
    w = Window.partitionBy(*by).orderBy(x)
    before, after = w.rowsBetween(-lookahead, -1), w.rowsBetween(1, lookahead)
    v = F.col(y)
    whole = (F.count(y).over(before) == lookahead) & (F.count(y).over(after) == lookahead)
    high = (v > F.max(y).over(before)) & (v > F.max(y).over(after)) & (v - F.min(y).over(before) >= delta) & (v - F.min(y).over(after) >= delta)
    low = (v < F.min(y).over(before)) & (v < F.min(y).over(after)) & (F.max(y).over(before) - v >= delta) & (F.max(y).over(after) - v >= delta)
    return df.withColumn("kind", F.when(whole & high, "max").when(whole & low, "min")).where("kind is not null")


def envelope(series: DataFrame, c: str, sigma: float | None = None, t: str = "t", f: str = "f") -> DataFrame:
    """(t, f, envelope): a series' smooth course plus the amplitude of what it leaves, by the analytic signal.

    sigma: of the smoothing, by default a tenth of the series' rows; 0 takes the mean. The transform needs a whole series, so a series is
    one group of a vectorised function; NULLs are left out.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(f)
        a = rows[c].to_numpy(float)
        n = len(a)
        width = n / 10 if sigma is None else sigma
        if width:
            r = int(4 * width + 0.5)
            k = np.exp(-((np.arange(-r, r + 1) / width) ** 2) / 2)
            smooth = np.convolve(np.pad(a, r, "symmetric"), k / k.sum(), "valid")
        else:
            smooth = np.full(n, a.mean())
        turn = np.zeros(n)
        turn[0] = 1
        turn[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            turn[n // 2] = 1
        return pd.DataFrame({t: rows[t], f: rows[f], "envelope": np.abs(np.fft.ifft(np.fft.fft(a - smooth) * turn)) + smooth})

    kinds = dict(series.dtypes)
    return series.select(t, f, F.col(c).cast("double").alias(c)).dropna().groupBy(t).applyInPandas(one, f"{t} {kinds[t]}, {f} {kinds[f]}, envelope double")
