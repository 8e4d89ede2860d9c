"""Structure within frames: pairs, neighbours, order parameters, pair distribution.

Pairs within a distance come from a join on (frame, cell), one side copied to the nine cells around its own, so a frame's
density and not its size bounds the pairs. Only `pairs` itself pairs all dots of a frame, as it is asked to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.functions.scalars import project
from pathfield.operators.binning import bin_index
from pathfield.operators.combine import joined_stats
from pathfield.operators.sequence import every_kth


def _side(dots: DataFrame, n: str, columns: list[str]) -> DataFrame:
    return dots.select("f", *[F.col(c).alias(f"{c}{n}") for c in dict.fromkeys(("id", "x", "y", *columns))])


#: Dots of a block, about; a frame with more is paired block by block.
PAIRED = 4_096


def pairs(dots: DataFrame, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """All pairs of dots of a frame with their distance d; both orders if ordered, else id1 < id2.

    Every two blocks of a large frame meet in one task, which so holds a block; a dot is copied as often as its frame has blocks.
    """
    a, b = _side(dots, "1", columns or []), _side(dots, "2", columns or [])
    blocks = dots.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("__n"))
    dealt = lambda side, n, own, other: side.join(blocks, "f").withColumns({own: F.pmod(F.xxhash64(f"id{n}"), F.col("__n")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("__n") - 1))}).drop("__n")
    on = (F.col("id1") != F.col("id2")) if ordered else (F.col("id1") < F.col("id2"))
    return dealt(a, 1, "__i", "__j").join(dealt(b, 2, "__j", "__i"), ["f", "__i", "__j"]).drop("__i", "__j").where(on).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _cells(a: DataFrame, b: DataFrame, size: Column) -> DataFrame:
    """Rows of both sides in the same or neighbouring cells of a frame; size is a Column of either side."""
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])
    a = a.withColumns({"__cx": cell("x1"), "__cy": cell("y1")})
    b = b.withColumn("__k", F.explode(around))
    b = b.withColumns({"__cx": cell("x2") + F.col("__k.i"), "__cy": cell("y2") + F.col("__k.j")}).drop("__k")
    return a.join(b, ["f", "__cx", "__cy"]).drop("__cx", "__cy")


def _distance() -> Column:
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def close_pairs(dots: DataFrame, reach: float, columns: list[str] | None = None, ordered: bool = True, closed: bool = False, first: list[str] | None = None) -> DataFrame:
    """As pairs, those nearer than reach (or as near, if closed), by a join on cells of that size. first: more columns, of the first dot alone."""
    on = (F.col("id1") != F.col("id2")) if ordered else (F.col("id1") < F.col("id2"))
    found = _cells(_side(dots, "1", [*(columns or []), *(first or [])]), _side(dots, "2", columns or []), F.lit(reach * (1 + 1e-9))).where(on).withColumn("d", _distance())
    return found.where(F.col("d") <= reach if closed else F.col("d") < reach)


#: Dots of a cell, for each of k, from which it counts as crowded; dots in the cells around one, for each of k, that a search wants; halvings of a frame's width at most.
CROWD, WANTED, DEEPEST = 64, 6, 40
#: Dots of a frame that the few whose own cells don't suffice may meet whole.
SMALL = 4_096


def knn(dots: DataFrame, k: int, columns: list[str] | None = None, reach: float | None = None, ties: int | None = None) -> DataFrame:
    """The k nearest of each dot in its frame, ties by id: pairs with rank. reach: none beyond it, found by cells. ties: distances count as equal to so many digits.

    Without reach, a frame's cells have a size by which a dot has about six times k others in the nine around it. A dot with k of them
    within that size has its nearest there; the few others meet their frame, if no frame has over SMALL dots, or search coarser cells (`_searched`). Where some cell is crowded, all dots search cells of their own depth.
    """
    order = Window.partitionBy("f", "id1").orderBy(F.col("d") if ties is None else F.round("d", ties), "id2")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if reach is not None:
        return top(close_pairs(dots, reach, columns))
    dots = dots.where("x is not null and y is not null")
    box = dots.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    longest = F.greatest("w", "h")
    side = F.greatest(F.sqrt(2.0 * k * F.col("w") * F.col("h") / F.col("n")), 2.0 * k * longest / F.col("n"))
    size = box.select("f", F.when(side > 0, side).otherwise(1.0).alias("__s"))
    cell = lambda c, s: F.floor(F.col(c) / F.col(s))
    cells = dots.select("f", "x", "y").join(size, "f").groupBy("f", cell("x", "__s").alias("i"), cell("y", "__s").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    crowd, largest = cells.groupBy("f").agg(F.max("n").alias("n"), F.sum("n").alias("all")).agg(F.max("n"), F.max("all")).first()
    a = _side(dots, "1", columns or [])
    if crowd is not None and crowd > CROWD * k:
        return top(_searched(a, dots, k, columns or [], box, True))
    a = a.join(size, "f")
    b = _side(dots, "2", columns or []).join(size.withColumnRenamed("__s", "__s2"), "f")
    b = b.withColumn("__k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])))
    a = a.withColumns({"__cx": cell("x1", "__s"), "__cy": cell("y1", "__s")})
    b = b.withColumns({"__cx": cell("x2", "__s2") + F.col("__k.i"), "__cy": cell("y2", "__s2") + F.col("__k.j")}).drop("__k", "__s2")
    near = a.join(b, ["f", "__cx", "__cy"]).drop("__cx", "__cy").where("id1 <> id2").withColumn("d", _distance()).where(F.col("d") <= F.col("__s") * (1 - 1e-9)).drop("__s")
    settled = near.groupBy("f", "id1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("f", "id1")
    rest = _side(dots, "1", columns or []).join(settled, ["f", "id1"], "left_anti")
    near = near.join(settled, ["f", "id1"], "left_semi")
    if largest is None or largest <= SMALL:
        met = rest.join(_side(dots, "2", columns or []), "f").where("id1 <> id2").withColumn("d", _distance())
        return top(near.unionByName(met))
    return top(near.unionByName(_searched(rest, dots, k, columns or [], box, False)))


def _searched(seekers: DataFrame, dots: DataFrame, k: int, columns: list[str], box: DataFrame, clustered: bool) -> DataFrame:
    """Pairs of each seeker (a side 1) with dots, its k nearest among them, by cells of several depths.

    A cell of depth e is a 2^-e part of its frame's width. The deepest cell with k others in the nine around it bounds the distance to the k nearest by less than three of
    its widths, so the nine cells two depths higher hold them. Where dots are clustered, a first search goes deeper, to the deepest nine cells with WANTED k dots, and only dots without k
    within a cell's width go on. Dots at one place count up to the k + 1 with the least ids, as no more can be anyone's nearest; so cells are split until few dots share one.
    Only dots far from a crowd meet it whole, and of these there are a few times k for each halving of the distance to it.
    """
    b = _side(dots, "2", columns)
    if clustered:
        place = Window.partitionBy("f", "x2", "y2").orderBy("id2")
        b = b.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k + 1).drop("__r")
    width = F.greatest("w", "h")
    depth = F.least(F.ceil(F.log2(F.col("n") / k + 1) / 2), F.lit(DEEPEST)).cast("int")
    grid = box.select("f", "x0", "y0", F.when(width > 0, width * (1 + 1e-9)).otherwise(1.0).alias("w"), depth.alias("deep"))
    # cells of the deepest level; those above come by halving their numbers
    at = lambda c, o: F.floor((F.col(c) - F.col(o)) / F.col("w") * float(1 << DEEPEST)).cast("long")
    up = lambda c, e="e", low=DEEPEST: F.call_function("shiftright", F.col(c), F.lit(low) - F.col(e) if isinstance(low, int) else F.col(low) - F.col(e))
    depths = F.explode(F.sequence(F.lit(0), F.col("deep"))).alias("e")
    if clustered:
        # each frame is halved until its cells are no longer crowded
        placed = b.join(grid, "f").groupBy("f", at("x2", "x0").alias("i"), at("y2", "y0").alias("j")).agg(F.count(F.lit(1)).alias("n"))
        every = placed.select("f", "i", "j", "n", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("e")).groupBy("f", "e", up("i").alias("i"), up("j").alias("j")).agg(F.sum("n").alias("n"))
        even = every.groupBy("f", "e").agg(F.max("n").alias("n")).groupBy("f").agg(F.coalesce(F.min(F.when(F.col("n") <= CROWD * k, F.col("e"))), F.lit(DEEPEST)).alias("deep"))
        grid = staged(grid.drop("deep").join(even, "f"), "grid")
    b = b.join(grid, "f").withColumns({"__i": at("x2", "x0"), "__j": at("y2", "y0")}).drop("x0", "y0")
    cells = b.groupBy("f", up("__i", "deep").alias("i"), up("__j", "deep").alias("j"), "deep").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("f", "deep", "i", "j", "n", depths).groupBy("f", "e", up("i", low="deep").alias("i"), up("j", low="deep").alias("j")).agg(F.sum("n").alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])).alias("k")
    blocks = cells.select("f", "e", "i", "j", "n", around).groupBy("f", "e", (F.col("i") + F.col("k.i")).alias("i"), (F.col("j") + F.col("k.j")).alias("j")).agg(F.sum("n").alias("n"))
    blocks = blocks.where(F.col("n") > k).select("f", "e", "i", "j", "n")
    a = seekers.join(grid, "f").withColumns({"__i": at("x1", "x0"), "__j": at("y1", "y0")})
    levels = a.select("f", "id1", "__i", "__j", depths).select("f", "id1", "e", up("__i").alias("i"), up("__j").alias("j")).join(blocks, ["f", "e", "i", "j"])
    wanted = F.max(F.when(F.col("n") > WANTED * k, F.col("e")))
    levels = levels.groupBy("f", "id1").agg(F.greatest(F.max("e") - 2, F.lit(0)).alias("sure"), F.coalesce(wanted, F.lit(0)).alias("near"))
    # a frame with fewer than k others is met whole
    a = a.join(levels, ["f", "id1"], "left").fillna(0, ["sure", "near"])
    many = b.select("f", "id2", "x2", "y2", *[f"{c}2" for c in columns if c not in ("id", "x", "y")], "__i", "__j", depths)
    many = many.withColumns({"__i": up("__i"), "__j": up("__j")})

    def met(a: DataFrame, level: str) -> DataFrame:
        rows = a.withColumn("e", F.col(level)).withColumns({"__i": up("__i"), "__j": up("__j")}).select("*", around)
        rows = rows.withColumns({"__i": F.col("__i") + F.col("k.i"), "__j": F.col("__j") + F.col("k.j")}).drop("k")
        found = rows.join(many, ["f", "e", "__i", "__j"]).where("id1 <> id2").withColumn("d", _distance())
        return found.withColumn("__s", F.when(F.col("e") > 0, F.col("w") / F.pow(F.lit(2.0), F.col("e")) * (1 - 1e-9)).otherwise(F.lit(float("inf"))))

    kept = ["f", *[c for c in seekers.columns if c != "f"], *[c for c in many.columns if c.endswith("2")], "d"]
    if not clustered:
        return met(a, "sure").select(*kept)
    first = met(a, "near").where(F.col("d") <= F.col("__s"))
    settled = first.groupBy("f", "id1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("f", "id1")
    rest = met(a.join(settled, ["f", "id1"], "left_anti"), "sure")
    return first.join(settled, ["f", "id1"], "left_semi").select(*kept).unionByName(rest.select(*kept))


def diameter(dots: DataFrame, directions: int = 32) -> DataFrame:
    """(f, d): the largest distance between two dots of each frame; 0 for a single one.

    The extents in some directions give a lower bound w. The farthest two lie at least w less the radius about the middle
    away from it, so only the dots near the rim are paired.
    """
    turns = F.array(*[F.struct(F.lit(math.cos(math.pi * k / directions)).alias("c"), F.lit(math.sin(math.pi * k / directions)).alias("s")) for k in range(directions)])
    along = dots.select("f", "x", "y", F.posexplode(turns).alias("k", "u")).select("f", "k", (F.col("x") * F.col("u.c") + F.col("y") * F.col("u.s")).alias("p"))
    width = along.groupBy("f", "k").agg((F.max("p") - F.min("p")).alias("w")).groupBy("f").agg(F.max("w").alias("w"))
    rows = centred(dots).join(width, "f").where(F.col("d0") >= F.col("w") * (1 - 1e-9) - F.col("d_max"))
    far = pairs(rows).groupBy("f").agg(F.max("d").alias("far"))
    return width.join(far, "f", "left").select("f", F.greatest(F.coalesce("far", F.lit(0.0)), F.lit(0.0)).alias("d"))


def adaptive_neighbours(dots: DataFrame, most: int, factor: float, of: str = "mean", least: int = 0) -> DataFrame:
    """Of each dot's nearest `most`, those within factor times the mean, least ('min'), largest ('max') or median of its distances to them.

    A dot left with fewer than `least` has none.
    """
    w = Window.partitionBy("f", "id1")
    scale = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[of]
    near = knn(dots, most).withColumn("limit", factor * scale("d").over(w)).where("d <= limit").drop("limit")
    return near if not least else near.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least).drop("__n")


def close_ratio_neighbours(dots: DataFrame, most: int = 4, ratio: float = 1.8, least: int = 2) -> DataFrame:
    """Of each dot's nearest `most`, those whose squared distance is below ratio times the least; dots left with fewer than `least` have none."""
    w = Window.partitionBy("f", "id1")
    near = knn(dots, most).withColumn("limit", ratio * F.pow(F.min("d").over(w), 2)).where("d * d < limit").drop("limit")
    return near.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least).drop("__n")


def bond_angles(neighbours: DataFrame) -> DataFrame:
    """Angle, in [0, 2 pi), from each dot to its neighbours, and relative to its nearest's."""
    angle = F.pmod(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.lit(2 * math.pi))
    first = F.first("angle").over(Window.partitionBy("f", "id1").orderBy("d", "id2"))
    return neighbours.withColumn("angle", angle).withColumn("relative", F.pmod(F.col("angle") - first, F.lit(2 * math.pi)))


def angle_gaps(neighbours: DataFrame, k: int) -> DataFrame:
    """(f, id, gap): angles between the neighbours that follow each other around a dot, for dots with exactly k of them."""
    a = bond_angles(neighbours)
    w = Window.partitionBy("f", "id1")
    after = F.lead("angle").over(w.orderBy("angle", "id2"))
    gap = F.coalesce(after, F.min("angle").over(w) + 2 * math.pi) - F.col("angle")
    return a.withColumns({"gap": gap, "n": F.count(F.lit(1)).over(w)}).where(F.col("n") == k).select("f", F.col("id1").alias("id"), "gap")


def psi_complex(neighbours: DataFrame, m: int = 4) -> DataFrame:
    """(f, id, re, im, n): mean of exp(i m angle) over a dot's neighbours."""
    a = bond_angles(neighbours)
    return a.groupBy("f", F.col("id1").alias("id")).agg(F.avg(F.cos(m * F.col("angle"))).alias("re"), F.avg(F.sin(m * F.col("angle"))).alias("im"), F.count(F.lit(1)).alias("n"))


def psi_local(neighbours: DataFrame, m: int = 4) -> DataFrame:
    """(f, id, psi): local bond order."""
    return psi_complex(neighbours, m).select("f", "id", F.hypot("re", "im").alias("psi"))


def psi_global(neighbours: DataFrame, m: int = 4) -> DataFrame:
    """(f, psi, phase): bond order of each frame, from the mean of the dots' complex values."""
    g = psi_complex(neighbours, m).groupBy("f").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return g.select("f", F.hypot("re", "im").alias("psi"), (F.atan2("im", "re") / m).alias("phase"))


def phi_global(dots: DataFrame, m: int = 4, margin: float | None = None) -> DataFrame:
    """(f, phi, phase, stderr): molecular order of each frame's orientations, of the dots inside the margin if given.

    stderr: the deviation of the dots' complex values about their mean, over the root of their number.
    """
    rows = dots if margin is None else inside(dots, margin)
    g = rows.groupBy("f").agg(F.avg(F.cos(m * F.col("o"))).alias("re"), F.avg(F.sin(m * F.col("o"))).alias("im"), F.count("o").alias("n"))
    rest = F.greatest(1 - F.col("re") * F.col("re") - F.col("im") * F.col("im"), F.lit(0.0))
    return g.select("f", F.hypot("re", "im").alias("phi"), (F.atan2("im", "re") / m).alias("phase"), F.sqrt(rest / F.col("n")).alias("stderr"))


def phi_local(neighbours: DataFrame, m: int = 4) -> DataFrame:
    """(f, id, phi): order of a dot's orientation differences to its neighbours, which have the columns o1 and o2."""
    turn = F.col("o2") - F.col("o1")
    g = neighbours.groupBy("f", F.col("id1").alias("id")).agg(F.avg(F.cos(m * turn)).alias("re"), F.avg(F.sin(m * turn)).alias("im"))
    return g.select("f", "id", F.hypot("re", "im").alias("phi"))


def density(neighbours: DataFrame, method: str = "dist") -> DataFrame:
    """(f, id, dens): from the neighbours' distances, 'dist' or 'inv' means, '_area' of their squares."""
    d = F.col("d")
    inverse = F.try_divide(F.lit(1.0), d)
    value = {"dist": F.try_divide(F.lit(1.0), F.pow(F.avg(d), 2)), "inv": F.pow(F.avg(inverse), 2), "dist_area": F.try_divide(F.lit(1.0), F.avg(d * d)), "inv_area": F.avg(inverse * inverse)}[method]
    return neighbours.groupBy("f", F.col("id1").alias("id")).agg(value.alias("dens"))


def centred(dots: DataFrame) -> DataFrame:
    """dots with d0, the distance to the middle of the frame's bounding box, and d_max, the frame's largest."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    out = joined_stats(dots, "f", __mx=mid("x"), __my=mid("y"))
    out = out.withColumn("d0", F.hypot(F.col("x") - F.col("__mx"), F.col("y") - F.col("__my"))).select(*dots.columns, "d0")
    return joined_stats(out, "f", d_max=F.max("d0"))


def inside(dots: DataFrame, margin: float) -> DataFrame:
    """Dots nearer to the middle of their frame than its farthest dot less a margin."""
    return centred(dots).where(F.col("d0") < F.col("d_max") - margin).select(*dots.columns)


def bulk_weight(dots: DataFrame, margin: float, side: float, radius: float | None = None) -> DataFrame:
    """(f, id, weight): share of a dot of that side that lies inside the frame's disk less a margin. radius: of the disk, by default the farthest dot's outer side.

    The farthest dot's distance to the middle is never less than half the largest separation, whose two dots lie at least that far apart by way of the middle.
    """
    edge = F.col("d_max") + side / 2 if radius is None else F.lit(radius)
    depth = (F.col("d0") - (edge - margin)) / side
    return centred(dots).select("f", "id", F.greatest(F.least(0.5 - depth, F.lit(1.0)), F.lit(0.0)).alias("weight"))


def bulk_count(dots: DataFrame, margin: float, side: float, radius: float | None = None, whole: float | None = None) -> DataFrame:
    """(f, n): sum of the bulk weights of each frame; whole: scaled to that many dots of a full frame."""
    g = bulk_weight(dots, margin, side, radius).groupBy("f").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("all"))
    return g.select("f", (F.col("w") if whole is None else F.col("w") * whole / F.col("all")).alias("n"))


def bulk_density(dots: DataFrame, margins: list[float], side: float, radius: float) -> DataFrame:
    """(margin, density): dots inside a disk less each margin, over what such a disk holds, summed over all frames. margins: a list known beforehand, each dot meets them all."""
    capacity = lambda m: math.pi * ((radius - m) / side) ** 2
    known = F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.lit(capacity(m)).alias("capacity")) for m in margins])
    rows = centred(dots).select("f", "d0", F.explode(known).alias("k")).select("f", "d0", "k.*")
    depth = (F.col("d0") - (radius - F.col("margin"))) / side
    sums = rows.groupBy("margin").agg(F.sum(F.greatest(F.least(0.5 - depth, F.lit(1.0)), F.lit(0.0))).alias("n"), F.max("capacity").alias("capacity"), F.count_distinct("f").alias("frames"))
    return sums.select("margin", (F.col("n") / F.col("capacity") / F.col("frames")).alias("density"))


def pair_distribution(dots: DataFrame, bins: int, rmax: float, margin: float, side: float, frame_step: int = 1) -> DataFrame:
    """(f, bin, g): radial distribution of each frame, corrected for the part of a ring that the disk leaves out.

    frame_step: of every so manieth frame, from the first one on. Only pairs within rmax are formed; bin i ends at (i + 1) rmax / bins. What a frame's pairs need of it goes with
    their first dot, so that pairs are added up where they are formed.
    """
    if frame_step > 1:
        dots = every_kth(dots, frame_step)
    rows = centred(dots)
    # half the largest separation is never more than the farthest dot's distance to the middle
    frames = rows.groupBy("f").agg((F.max("d_max") + side / 2).alias("rs"))
    counts = rows.join(frames, "f").where(F.col("d0") <= F.col("rs") - margin).groupBy("f").agg(F.count(F.lit(1)).alias("inner"))
    rows = rows.join(frames, "f").join(counts, "f")
    q = close_pairs(rows, rmax, ["d0"], False, True, ["rs", "inner"]).where("d > 0").withColumnsRenamed({"rs1": "rs", "inner1": "inner"})
    dr = rmax / bins

    def weight(c: str) -> Column:
        cos = F.greatest(F.lit(-1.0), F.try_divide(F.col("d") ** 2 + F.col(c) ** 2 - F.col("rs") ** 2, 2 * F.col("d") * F.col(c)))
        arc = 2 * F.acos(F.coalesce(cos, F.lit(-1.0))) * F.col("d") * dr
        return F.when(F.col(c) <= F.col("rs") - margin, F.try_divide(F.lit(1.0), arc)).otherwise(0.0)

    part = (weight("d01") + weight("d02")) / F.col("inner")
    return q.select("f", bin_index(F.col("d"), 0.0, rmax, bins).alias("bin"), part.alias("w")).where("bin is not null").groupBy("f", "bin").agg(F.sum("w").alias("g"))


def displacement_histogram(dots: DataFrame, bins: int, rmax: float) -> DataFrame:
    """(i, j, n): ordered pairs by their displacement in x and y, both within rmax."""
    p = close_pairs(dots, rmax * math.sqrt(2) * (1 + 1e-12), None, True, True)
    i, j = bin_index(F.col("x2") - F.col("x1"), -rmax, rmax, bins), bin_index(F.col("y2") - F.col("y1"), -rmax, rmax, bins)
    return p.select(i.alias("i"), j.alias("j")).dropna().groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def weighted_displacements(dots: DataFrame, bins: int, rmax: float, margin: float, side: float) -> DataFrame:
    """(i, j, n, g): the pair distribution in x and y: pairs nearer than rmax by their displacement from dots inside the margin, bins a side from -rmax to rmax.

    g weighs a pair by the full circle over the part of the ring through the second dot that lies in the frame's disk, over the square of the disk's radius by bins.
    """
    q = close_pairs(centred(dots), rmax, ["d0", "d_max"]).where(F.col("d01") < F.col("d_max1") - margin)
    radius = F.col("d_max1") + side / 2
    cos = F.coalesce(F.try_divide(F.col("d") ** 2 + F.col("d01") ** 2 - radius**2, 2 * F.col("d") * F.col("d01")), F.lit(-1.0))
    arc = 2 * F.acos(F.greatest(cos, F.lit(-1.0)))
    w = F.when((cos < 1) & (arc > 0), F.pow(bins / radius, F.lit(2.0)) * 2 * math.pi / arc).otherwise(0.0)
    i, j = bin_index(F.col("x2") - F.col("x1"), -rmax, rmax, bins), bin_index(F.col("y2") - F.col("y1"), -rmax, rmax, bins)
    return q.select(i.alias("i"), j.alias("j"), w.alias("w")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("g"))


def squares(dots: DataFrame, side: float, shrink: float = 0.9) -> DataFrame:
    """(f, id, corner, x, y): corners 0 .. 3 of each dot's oriented square, of that side times shrink, in turn from the one an eighth of a turn before its orientation."""
    reach = side / math.sqrt(2) * shrink
    turns = F.posexplode(F.array(*[F.lit(-math.pi / 4 * k) for k in (1, 3, 5, 7)])).alias("corner", "turn")
    rows = dots.select("f", "id", "x", "y", "o", turns)
    return rows.select("f", "id", "corner", (F.col("x") + reach * F.cos(F.col("o") + F.col("turn"))).alias("x"), (F.col("y") + reach * F.sin(F.col("o") + F.col("turn"))).alias("y"))


def radial_correlation(dots: DataFrame, value, columns: list[str], bins: int, rmax: float, margin: float | None = None, total: bool = False) -> DataFrame:
    """(bin, n, c): mean, or sum if total, over all pairs at a distance of value(first, second), a function of the two sides' Columns by name.

    margin: of the dots inside it alone.
    """
    p = close_pairs(dots if margin is None else inside(dots, margin), rmax, columns, False, True)
    side = lambda n: {c: F.col(f"{c}{n}") for c in columns}
    rows = p.select(bin_index(F.col("d"), 0.0, rmax, bins).alias("bin"), value(side("1"), side("2")).alias("v")).where("bin is not null")
    return rows.groupBy("bin").agg(F.count("v").alias("n"), (F.sum("v") if total else F.avg("v")).alias("c"))


def orientation_correlation(dots: DataFrame, bins: int, rmax: float, m: int = 4, margin: float | None = None) -> DataFrame:
    """(bin, n, c): mean cos(m (o1 - o2)) against distance, of the dots inside the margin if given."""
    return radial_correlation(dots, lambda a, b: F.cos(m * (a["o"] - b["o"])), ["o"], bins, rmax, margin)


def bond_correlation(neighbours: DataFrame, dots: DataFrame, bins: int, rmax: float, m: int = 4) -> DataFrame:
    """(bin, n, c): real part of conj(psi1) psi2 against distance."""
    rows = dots.join(psi_complex(neighbours, m).select("f", "id", "re", "im"), ["f", "id"])
    return radial_correlation(rows, lambda a, b: a["re"] * b["re"] + a["im"] * b["im"], ["re", "im"], bins, rmax)


def binder(dots: DataFrame, reach: float, m: int = 4) -> DataFrame:
    """(f, re, im): cumulant 1 - <phi^4> / (3 <phi^2>^2) of the mean order around each dot, itself included, in complex numbers."""
    near = close_pairs(dots, reach, ["o"]).select("f", F.col("id1").alias("id"), F.col("o2").alias("o"))
    around = near.unionByName(dots.select("f", "id", "o"))
    g = around.groupBy("f", "id").agg(F.avg(F.cos(m * F.col("o"))).alias("a"), F.avg(F.sin(m * F.col("o"))).alias("b"))
    g = g.select("f", (F.col("a") ** 2 - F.col("b") ** 2).alias("p"), (2 * F.col("a") * F.col("b")).alias("q"))
    s = g.groupBy("f").agg(F.avg("p").alias("p"), F.avg("q").alias("q"), F.avg(F.col("p") ** 2 - F.col("q") ** 2).alias("u"), F.avg(2 * F.col("p") * F.col("q")).alias("v"))
    s = s.select("f", "u", "v", (3 * (F.col("p") ** 2 - F.col("q") ** 2)).alias("c"), (6 * F.col("p") * F.col("q")).alias("d"))
    n = F.col("c") ** 2 + F.col("d") ** 2
    return s.select("f", (1 - F.try_divide(F.col("u") * F.col("c") + F.col("v") * F.col("d"), n)).alias("re"), (-F.try_divide(F.col("v") * F.col("c") - F.col("u") * F.col("d"), n)).alias("im"))


def square_overlaps(dots: DataFrame, half: float, shrink: float = 0.9) -> DataFrame:
    """(f, id1, id2) of oriented squares, of that half side times shrink, that overlap: no edge direction separates them."""
    h = half * shrink
    p = close_pairs(dots, 2 * h * math.sqrt(2), ["o"], False)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.col("o2") - F.col("o1")
    width = h * (1 + F.abs(F.cos(turn)) + F.abs(F.sin(turn)))
    apart = [F.abs(dx * F.cos(a) + dy * F.sin(a)) > width for o in ("o1", "o2") for a in (F.col(o), F.col(o) + math.pi / 2)]
    return p.where(~(apart[0] | apart[1] | apart[2] | apart[3])).select("f", "id1", "id2")


def rectify(dots: DataFrame, m: int = 4) -> DataFrame:
    """dots turned back by their frame's bond axis, the phase of the two nearest neighbours' order, about the frame's mean place."""
    axis = psi_global(knn(dots, 2), m).select("f", F.col("phase").alias("__a"))
    rows = joined_stats(dots, "f", __mx=F.avg("x"), __my=F.avg("y")).join(axis, "f").withColumns({"__x": F.col("x") - F.col("__mx"), "__y": F.col("y") - F.col("__my")})
    x, y = project(F.col("__x"), F.col("__y"), F.col("__a"))
    turned = rows.withColumns({"x": x, "y": y})
    return (turned.withColumn("o", F.col("o") - F.col("__a")) if "o" in dots.columns else turned).select(*dots.columns)
