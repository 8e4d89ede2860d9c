"""Shells of a square cluster and statistics by shell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators.combine import joined_stats
from pathfield.operators.spatial import knn, psi_global


def ring_valency(dots: DataFrame) -> DataFrame:
    """(f, id, ring): dots by distance from the frame's mean place, ring n holding 1, 8, 16, 24, ... of them."""
    d = F.pow(F.col("x") - F.col("__mx"), 2) + F.pow(F.col("y") - F.col("__my"), 2)
    rank = F.row_number().over(Window.partitionBy("f").orderBy("d", "id"))
    rows = joined_stats(dots, "f", __mx=F.avg("x"), __my=F.avg("y")).withColumn("d", F.round(d, 9)).select("f", "id", rank.alias("k"))
    return rows.select("f", "id", F.ceil((F.sqrt(F.col("k").cast("double")) + 1) / 2).cast("int").alias("ring"))


def reference_basis(dots: DataFrame, m: int = 4) -> DataFrame:
    """(f, psi, phase): size and direction of each frame's bond axis, by the two nearest neighbours; a weak psi makes a poor axis."""
    return psi_global(knn(dots, 2), m)


def assign_shells(dots: DataFrame, width: int, m: int = 4) -> DataFrame:
    """(f, id, sh): square shells 0 .. (width - 1) / 2 of a cluster of width x width dots, along the frame's bond axis."""
    if width % 2 == 0:
        raise ValueError("the width is odd")
    axis = reference_basis(dots, m).select("f", F.col("phase").alias("a"))
    c, s = F.cos("a"), F.sin("a")
    rows = dots.join(axis, "f").select("f", "id", (F.col("x") * c + F.col("y") * s).alias("u"), (F.col("y") * c - F.col("x") * s).alias("v"))
    sides = {n: c for k in "uv" for n, c in ((f"m{k}", F.avg(k)), (f"w{k}", (F.max(k) - F.min(k)) / (width - 1)))}
    place = lambda k: F.try_divide(F.col(k) - F.col(f"m{k}"), F.col(f"w{k}"))
    return joined_stats(rows, "f", **sides).withColumns({"i": place("u"), "j": place("v")}).select("f", "id", F.rint(F.greatest(F.abs("i"), F.abs("j"))).cast("int").alias("sh"))


def track_shells(tracks: DataFrame, width: int, m: int = 4) -> DataFrame:
    """tracks with sh: the shell its track has in the first frame, in all frames; -1 for tracks that begin later."""
    first = tracks.agg(F.min("f").alias("f0"))
    start = tracks.join(F.broadcast(first), F.col("f") == F.col("f0")).drop("f0")
    known = assign_shells(start, width, m).join(start.select("id", F.col("t").alias("__t")), "id").select("__t", "sh")
    return tracks.join(known, F.col("t") == F.col("__t"), "left").drop("__t").withColumn("sh", F.coalesce("sh", F.lit(-1)))


def melt_stats(tracks: DataFrame, width: int, m: int = 4, fewest: int = 2) -> DataFrame:
    """(f, id, t, sh, dens, psi, phi): density, bond order and molecular order of every dot among its 4 nearest, 3 on the outermost shell.

    phi compares orientations with the neighbours'. Dots with fewer than `fewest` neighbours have NULLs.
    """
    rows = staged(track_shells(tracks, width, m), "shells")
    near = knn(rows, 4, ["o", "sh"]).where((F.col("rank") <= 3) | (F.col("sh1") != (width - 1) // 2))
    bond, turn = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.col("o2") - F.col("o1")
    order = lambda a: F.hypot(F.avg(F.cos(m * a)), F.avg(F.sin(m * a)))
    stats = near.groupBy("f", F.col("id1").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.lit(1.0), F.pow(F.avg("d"), 2)).alias("dens"), order(bond).alias("psi"), order(turn).alias("phi"))
    return rows.select("f", "id", "t", "sh").join(stats.where(F.col("n") >= fewest).drop("n"), ["f", "id"], "left")


def normalised(stats: DataFrame, value: str) -> DataFrame:
    """stats with a value over its largest of all."""
    top = stats.agg(F.max(value).alias("__top"))
    return stats.join(F.broadcast(top)).withColumn(value, F.try_divide(value, "__top")).drop("__top")


def by_shell(stats: DataFrame, value: str, zero_to: int | None = None) -> DataFrame:
    """(f, sh, n, mean): mean of a value for each shell of each frame, and for all known shells (sh NULL). zero_to: shell 0 counts as it."""
    sh = F.col("sh") if zero_to is None else F.when(F.col("sh") == 0, zero_to).otherwise(F.col("sh"))
    rows = stats.where("sh >= 0").withColumn("sh", sh)
    cube = rows.groupingSets([["f", "sh"], ["f"]], "f", "sh")
    return cube.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
