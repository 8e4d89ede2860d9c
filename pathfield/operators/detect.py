"""Dots from pixels: a table (f, r, c, v) of values in [0, 1]."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators.combine import joined_stats
from pathfield.operators.graph import components


def clip_scale(pixels: DataFrame, width: float = 2.0) -> DataFrame:
    """Values clipped to mean +- width standard deviations of their frame and scaled to [0, 1]."""
    rows = joined_stats(pixels, "f", __m=F.avg("v"), __s=F.stddev_pop("v"))
    m, s = F.col("__m"), width * F.col("__s")
    return stretch(rows.withColumn("v", F.greatest(F.least("v", m + s), m - s)).select(*pixels.columns))


def disk_kernel(width: float, inner: float, outer: float | None = None) -> list[tuple[int, int, float]]:
    """(dr, dc, w): a flat disk with a Gaussian rim, of sum 0 and unit deviation inside. outer: where it ends, by default four widths on."""
    outer = inner + 4 * width if outer is None else outer
    n = int(math.ceil(outer))
    cells = [(i, j, math.hypot(i, j)) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i, j) <= outer]
    w = [1.0 if d <= inner else math.exp(-(((d - inner) / width) ** 2) / 2) for _, _, d in cells]
    mean = sum(w) / len(w)
    sd = math.sqrt(sum((x - mean) ** 2 for x in w) / len(w)) or 1.0
    return [(i, j, (x - mean) / sd) for (i, j, _), x in zip(cells, w, strict=True)]


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Zero-padded convolution: each pixel sends a share along each cell of the kernel, an array of constants, to a grouped sum."""
    dr, dc, w = (F.lit(list(c)) for c in zip(*kernel, strict=True))
    moved = pixels.where("v <> 0").select("f", "r", "c", "v", F.explode(F.arrays_zip(dr.alias("dr"), dc.alias("dc"), w.alias("w"))).alias("k"))
    sums = moved.groupBy("f", (F.col("r") + F.col("k.dr")).alias("r"), (F.col("c") + F.col("k.dc")).alias("c")).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))
    return pixels.select("f", "r", "c").join(sums, ["f", "r", "c"], "left").fillna(0.0, ["v"])


def stretch(pixels: DataFrame) -> DataFrame:
    """Values of each frame moved and scaled to 0 .. 1; a frame of one value becomes 0."""
    rows = joined_stats(pixels, "f", __low=F.min("v"), __high=F.max("v"))
    return rows.withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))).select(*pixels.columns)


def label(pixels: DataFrame, threshold: float) -> DataFrame:
    """(f, r, c, v, label): connected pixels (4 neighbours) above a threshold; a label is the smallest pixel of its piece.

    A threshold of 1 or more counts in standard deviations over the frame's mean, a smaller one is a value. Pieces are the connected components of
    the links between neighbours.
    """
    rows = joined_stats(pixels, "f", k=threshold * F.stddev_pop("v") + F.avg("v")) if threshold >= 1 else pixels.withColumn("k", F.lit(threshold))
    on = staged(rows.where("v > k").select("f", "r", "c", "v"), "pixels")
    # the number of a pixel: frame, row and column in 20, 22 and 22 bits
    pixel = lambda r, c: F.shiftleft(F.col("f").cast("long"), 44) + F.shiftleft(F.col(r).cast("long"), 22) + F.col(c)
    on = on.withColumn("id", pixel("r", "c"))
    there = on.select("f", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("id").alias("b"))
    steps = F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")))
    sent = on.select("f", F.col("id").alias("a"), "r", "c", F.explode(steps).alias("k")).select("f", "a", (F.col("r") + F.col("k.i")).alias("r2"), (F.col("c") + F.col("k.j")).alias("c2"))
    pieces = components(sent.join(there, ["f", "r2", "c2"]).select("a", "b"), "pixel-links")
    return on.join(pieces, "id", "left").select("f", "r", "c", "v", F.coalesce("component", "id").alias("label"))


def remove_disks(pixels: DataFrame, found: DataFrame, radius: float, value: float | None = None) -> DataFrame:
    """pixels without the disks around dots (f, x column, y row): their values become `value`, or the frame's mean.

    A join on the pixels a disk covers, by dots rounded to whole pixels.
    """
    n = int(radius)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i, j) <= radius])
    gone = found.select("f", F.rint("y").cast("int").alias("y"), F.rint("x").cast("int").alias("x"), F.explode(cells).alias("k"))
    gone = gone.select("f", (F.col("y") + F.col("k.i")).alias("r"), (F.col("x") + F.col("k.j")).alias("c")).distinct().withColumn("gone", F.lit(True))
    filled = joined_stats(pixels, "f", fill=F.avg("v")) if value is None else pixels.withColumn("fill", F.lit(float(value)))
    rows = filled.join(gone, ["f", "r", "c"], "left")
    return rows.withColumn("v", F.when(F.col("gone"), F.col("fill")).otherwise(F.col("v"))).select(*pixels.columns)


def segments(labelled: DataFrame, low: int, high: int, ecc: float, circle: tuple[float, float, float] | None = None, weighted: bool = True, keep: bool = False) -> DataFrame:
    """(f, x, y, lab, ecc, area) of pieces within an area and an eccentricity, at their centres, weighted by values if not all are 0.

    circle: (x, y, radius) that must hold the centre. keep: all pieces, with a column kept.
    """
    v = F.col("v") if weighted else F.lit(1.0)
    x, y = (F.coalesce(F.try_divide(F.sum(v * F.col(k)), F.sum(v)), F.avg(k)) for k in ("c", "r"))
    rows = labelled.groupBy("f", F.col("label").alias("lab")).agg(x.alias("x"), y.alias("y"), F.count(F.lit(1)).alias("area"), F.var_pop("c").alias("a"), F.var_pop("r").alias("b"), F.covar_pop("c", "r").alias("m"))
    rows = rows.withColumns({"a": F.col("a") + 1 / 12, "b": F.col("b") + 1 / 12})
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("m", 2))
    rows = rows.withColumn("ecc", F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root))))
    good = F.col("area").between(low, high) & (F.col("ecc") <= ecc)
    if circle:
        good = good & (F.pow(F.col("x") - circle[0], 2) + F.pow(F.col("y") - circle[1], 2) <= circle[2] ** 2)
    names = ["f", "x", "y", "lab", "ecc", "area"]
    return rows.select(*names, good.alias("kept")) if keep else rows.where(good).select(*names)


def default_areas(kernel: float) -> tuple[int, int]:
    """Smallest and largest area of a dot found with a kernel of that size: half and twice its disk."""
    return int(math.pi * kernel**2 / 2), int(2 * math.pi * kernel**2) + 1


def find_dots(pixels: DataFrame, kernel: float, threshold: float = 3.0, areas: tuple[int, int] | None = None, ecc: float = 0.8, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """Dots of clipped and scaled pixels: convolution with a disk of that size (negative: dark dots), stretch, threshold, pieces, filter."""
    low, high = areas or default_areas(abs(kernel))
    rows = pixels.withColumn("v", 1 - F.col("v")) if kernel < 0 else pixels
    smooth = stretch(convolve(rows, disk_kernel(0.5 * abs(kernel), abs(kernel))))
    pieces = label(smooth, threshold).drop("v").join(rows.select("f", "r", "c", "v"), ["f", "r", "c"])
    return segments(pieces, low, high, ecc, circle)


def find_dots_and_corners(pixels: DataFrame, kernel: float, corner_kernel: float, threshold: float = 3.0, corner_threshold: float = 2.0, **kept) -> tuple[DataFrame, DataFrame]:
    """Dots, and corners found in the pixels that are left when the dots are removed."""
    found = staged(find_dots(pixels, kernel, threshold, **kept), "dots")
    return found, find_dots(remove_disks(pixels, found, abs(kernel)), corner_kernel, corner_threshold, **kept)
