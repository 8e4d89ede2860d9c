"""Linking dots into tracks.

A dot's parent depends on places alone: the nearest dot of the latest earlier frame, up to `giveup` back, that has one
within the reach of that gap. So parents come from searches of the nearest place over cells, fine ones first where dots are crowded, and track numbers from the roots that pointer doubling
finds, without a pass in frame order. Dots at one place of a frame are searched for, and search, once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators.graph import roots

#: Places of a cell from which a search begins in finer cells; levels of cells at most, each a quarter as wide as the one before.
CROWD, DEEPEST = 32, 12


def parents(dots: DataFrame, reach: float = 20.0, giveup: int = 10, cut: str | None = None) -> DataFrame:
    """(id, f, parent): parent NULL for a root.

    The first gap n with a dot nearer than sqrt(n) reach decides; the nearest such dot becomes the parent unless another dot of this
    frame is strictly nearer to it. cut: a boolean column; a cut dot has no parent and is nobody's.
    """
    is_cut = F.coalesce(F.col(cut), F.lit(False)) if cut else F.lit(False)
    rows = dots.select("id", "f", "x", "y", is_cut.alias("cut"))
    # the dot of the least id stands for its place
    first = F.min(F.struct("id", "cut")).alias("first")
    places = staged(rows.where("f is not null and x is not null and y is not null").groupBy("f", "x", "y").agg(first).select("f", "x", "y", F.col("first.id").alias("p"), F.col("first.cut").alias("p_cut")), "places")
    chosen, rest = None, places.select("f", "x", "y")
    for gaps in ([1], range(2, giveup + 1)):
        if not gaps:
            continue
        near = _nearest(rest, places, reach, gaps, chosen is None)
        best = staged(near.groupBy("f", "x", "y").agg(F.min(F.struct("n", "d", "p", "px", "py", "p_cut")).alias("b")).select("f", "x", "y", "b.*"), "nearest")
        rest = rest.join(best, ["f", "x", "y"], "left_anti")
        chosen = best if chosen is None else chosen.unionByName(best)
    chosen = chosen.where("not p_cut")
    # only the nearest of those that chose a dot can have it, and not if there is a nearer one that chose another
    first = staged(chosen.groupBy("n", "f", "p", "px", "py").agg(F.min("d").alias("d")), "chosen")
    linked = chosen.join(first.join(_beaten(first, places, reach * math.sqrt(giveup)), ["n", "p"], "left_anti").select("n", "p", "d"), ["n", "p", "d"])
    found = rows.join(linked.select("f", "x", "y", F.col("p").alias("parent")), ["f", "x", "y"], "left")
    return found.select("id", "f", F.when(~F.col("cut"), F.col("parent")).alias("parent"))


def _distance() -> Column:
    """The SQL's own operations, as the last digit decides between places that are equally far."""
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return F.sqrt(dx * dx + dy * dy)


def _in_cells(df: DataFrame, x: str, y: str, radius: Column, width: Column, copied: bool) -> DataFrame:
    """df with cx, cy: the cell of (x, y), or, copied, a row for each cell within the radius, which is less than half the width."""
    cell = lambda v: F.floor(v / width)
    if not copied:
        return df.withColumns({"cx": cell(F.col(x)), "cy": cell(F.col(y))})
    r = radius * (1 + 1e-9)
    touched = lambda c: F.explode(F.array_distinct(F.array(cell(F.col(c) - r), cell(F.col(c) + r))))
    return df.withColumn("cx", touched(x)).withColumn("cy", touched(y))


def _nearest(seekers: DataFrame, places: DataFrame, reach: float, gaps: Sequence[int], many: bool) -> DataFrame:
    """(n, f, x, y, d, p, px, py, p_cut): the nearest place n frames before each seeker (f, x, y), within the reach of that gap. many: the seekers are about as many as the places.

    Searches go from the cells in which places are few to those as wide as the reach allows. What lies no farther than a level's radius is the nearest; only seekers without such a place go on.
    """
    n = F.explode(F.array(*[F.lit(k) for k in gaps]))
    left = seekers.withColumn("n", n).withColumn("g", F.col("f") - F.col("n"))
    old = places.select(F.col("f").alias("g"), F.col("x").alias("px"), F.col("y").alias("py"), "p", "p_cut").withColumn("n", n)
    far = reach * F.sqrt(F.col("n").cast("double"))
    radius = lambda e: far / 4.0**e
    left = left if many else staged(left, "seekers")
    deepest, out = 0, None
    while deepest < DEEPEST:
        cells = _in_cells(old, "px", "py", radius(deepest), 4 * radius(deepest), False).groupBy("n", "g", "cx", "cy").agg(F.count(F.lit(1)).alias("c"))
        if not many:
            cells = cells.join(_in_cells(left, "x", "y", radius(deepest), 4 * radius(deepest), True), ["n", "g", "cx", "cy"], "left_semi")
        crowd = cells.agg(F.max("c")).first()[0] or 0
        if crowd <= CROWD:
            break
        deepest = min(DEEPEST, deepest + max(1, math.ceil(math.log(crowd / CROWD, 16))))
    for e in range(deepest, -1, -1):
        # the side with fewer rows goes to all cells that it touches; a seeker in one cell is settled there, without another shuffle
        all_seek = many and e == deepest
        a = _in_cells(left, "x", "y", radius(e), 4 * radius(e), not all_seek)
        b = _in_cells(old, "px", "py", radius(e), 4 * radius(e), all_seek)
        near = a.join(b, ["n", "g", "cx", "cy"]).withColumn("d", _distance())
        near = near.where((F.col("d") < far) & (F.col("d") <= radius(e)))
        keys = ["n", "g", "f", "x", "y", *(["cx", "cy"] if all_seek else [])]
        found = near.groupBy(*keys).agg(F.min(F.struct("d", "p", "px", "py", "p_cut")).alias("b"))
        found = staged(found.select("n", "f", "x", "y", "b.*"), "near")
        out = found if out is None else out.unionByName(found)
        if e:
            left = staged(left.join(found, ["n", "f", "x", "y"], "left_anti"), "seekers")
    return out


def _beaten(first: DataFrame, places: DataFrame, far: float) -> DataFrame:
    """(n, p) of first (n, f, p, px, py, d) that have a place of frame f nearer than d, which is less than far. Cells are a few times as wide as d."""
    wide = F.greatest(F.least(F.floor(F.log(F.lit(far) / F.col("d")) / math.log(4.0) - 1e-9), F.lit(DEEPEST)), F.lit(0)).cast("int")
    seek = first.where("d > 0").withColumn("e", wide)
    depths = sorted(r[0] for r in seek.select("e").distinct().collect())
    if not depths:
        return first.select("n", "p").limit(0)
    width = 4 * far / F.pow(F.lit(4.0), F.col("e"))
    a = _in_cells(seek, "px", "py", F.col("d"), width, True)
    b = _in_cells(places.select("f", "x", "y", F.explode(F.array(*[F.lit(e) for e in depths])).alias("e")), "x", "y", F.col("e"), width, False).withColumnsRenamed({"f": "bf", "e": "be", "cx": "bx", "cy": "by"})
    on = [F.col(k) == F.col(m) for k, m in (("f", "bf"), ("e", "be"), ("cx", "bx"), ("cy", "by"))]
    return a.join(b, [*on, _distance() < F.col("d")], "left_semi").select("n", "p")


def track_labels(dots: DataFrame, reach: float = 20.0, giveup: int = 10, cut: str | None = None, stub: int = 0, most: int | None = None) -> DataFrame:
    """(id, t): tracks numbered from 0 by their first dot's id; -1 for cut dots, for tracks of fewer than `stub` dots and for all but the first `most` tracks, if given."""
    found = roots(parents(dots, reach, giveup, cut))
    if cut:
        found = found.join(dots.where(F.coalesce(F.col(cut), F.lit(False))).select("id"), "id", "left_anti")
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    # a global rank of the roots alone, in ranges: counts of the ranges before, then ranks inside
    numbered = dense_rank(sizes, "root", more=["n"])
    labels = found.join(numbered, "root")
    labels = labels.select("id", F.when((F.col("n") >= stub) & (F.lit(True) if most is None else F.col("rank") < most), F.col("rank")).otherwise(-1).alias("t"))
    return dots.select("id").join(labels, "id", "left").select("id", F.coalesce("t", F.lit(-1)).cast("long").alias("t"))


def dense_rank(keys: DataFrame, key: str, parts: int = 64, more: Sequence[str] = ()) -> DataFrame:
    """(key, rank from 0) of distinct keys, and more of their columns, without a window over all rows: a staged table in ranges, the ranges' counts summed up, ranks within each."""
    rows = staged(keys.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("__p").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return rows.withColumn("__r", inner).join(F.broadcast(sizes.select("__p", "__before")), "__p").select(key, *more, (F.col("__r") + F.col("__before")).alias("rank"))


def outside(dots: DataFrame, x0: float, y0: float, radius: float, margin: float) -> DataFrame:
    """dots with cut: whether one lies beyond a disk less its margin."""
    return dots.withColumn("cut", F.hypot(F.col("x") - x0, F.col("y") - y0) > radius - margin)
