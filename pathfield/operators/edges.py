"""Outlines of bright or dark segments in pixels (f, r, c, v): smoothed gradients, thinned to lines and joined by hysteresis.

Every step is a stencil: a pixel sends its value to the places that need it, and one grouped aggregation gathers them. Suppression compares a pixel with what lies a step along its gradient on either side; hysteresis keeps the
weak pixels whose piece has a strong one; thinning peels the outline in rounds, of which each is a staged table, until none peels any more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators.graph import components, staged_and_seen

#: The eight pixels around one, in turn, from the one above.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _steps(cells: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate(cells)])).alias("s")


def around(pixels: DataFrame, columns: list[str], cells: list[tuple[int, int]] | None = None) -> DataFrame:
    """pixels with arrays n_<column> of the values at the cells around each, in their order; NULL where there is no pixel."""
    cells = cells or RING
    sent = pixels.select("f", "r", "c", *columns, _steps(cells))
    sent = sent.groupBy("f", (F.col("r") - F.col("s.i")).alias("r"), (F.col("c") - F.col("s.j")).alias("c")).agg(*[F.map_from_entries(F.collect_list(F.struct(F.col("s.k"), F.col(x)))).alias(f"m_{x}") for x in columns])
    met = pixels.join(sent, ["f", "r", "c"], "left")
    return met.withColumns({f"n_{x}": F.array(*[F.try_element_at(f"m_{x}", F.lit(k)) for k in range(len(cells))]) for x in columns}).drop(*[f"m_{x}" for x in columns])


def smoothed(pixels: DataFrame, sigma: float) -> DataFrame:
    """Values under a Gaussian, along columns and then along rows; beyond the image its weights are left out."""
    n = int(4 * sigma + 0.5)
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-n, n + 1)])
    out = pixels.select("f", "r", "c", F.col("v").cast("double").alias("v"))
    for axis, other in (("r", "c"), ("c", "r")):
        sent = out.select("f", axis, other, "v", F.explode(weights).alias("s"))
        sums = sent.groupBy("f", (F.col(axis) + F.col("s.k")).alias(axis), other).agg((F.sum(F.col("v") * F.col("s.w")) / F.sum("s.w")).alias("v"))
        out = out.select("f", "r", "c").join(sums, ["f", "r", "c"])
    return out


def edge_pixels(pixels: DataFrame, sigma: float = 2.0, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """(f, r, c) of pixels on edges: largest along the gradient, steeper than low and joined by such pixels to one steeper than high."""
    g = around(smoothed(pixels, sigma), ["v"])
    n = lambda k: F.get("n_v", F.lit(k))
    # a row or column counts twice in the middle; at the rim, where a pixel is missing, there is no gradient
    down = (n(3) + 2 * n(4) + n(5)) - (n(7) + 2 * n(0) + n(1))
    right = (n(1) + 2 * n(2) + n(3)) - (n(5) + 2 * n(6) + n(7))
    g = g.select("f", "r", "c", down.alias("gr"), right.alias("gc")).where("gr is not null and gc is not null").withColumn("m", F.hypot("gr", "gc"))
    g = around(staged(g, "gradients"), ["m"])
    a, b = F.abs("gr"), F.abs("gc")
    share = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
    s, t = F.when(F.col("gr") >= 0, 1).otherwise(-1), F.when(F.col("gc") >= 0, 1).otherwise(-1)
    place = {cell: k for k, cell in enumerate(RING)}
    at = lambda i, j: F.coalesce(F.element_at(F.col("n_m"), F.element_at(F.create_map(*[F.lit(x) for (p, q), k in place.items() for x in (3 * p + q, k + 1)]), (3 * i + j).cast("int"))), F.lit(0.0))
    # between the straight and the slanting neighbour on the gradient's side
    ahead = [at(x * F.when(a >= b, s).otherwise(0), x * F.when(a >= b, 0).otherwise(t)) * (1 - share) + at(x * s, x * t) * share for x in (1, -1)]
    weak = g.withColumns({"p": ahead[0], "q": ahead[1]}).where((F.col("m") > low) & (F.col("m") >= F.col("p") - 1e-12) & (F.col("m") >= F.col("q") - 1e-12)).select("f", "r", "c", "m")
    pieces = _pieces(staged(weak, "weak"))
    strong = pieces.groupBy("label").agg(F.max("m").alias("top")).where(F.col("top") > high).select("label")
    return pieces.join(strong, "label", "left_semi").select("f", "r", "c")


def _pieces(on: DataFrame) -> DataFrame:
    """on with label, the smallest pixel's number of its piece of touching pixels, corners included."""
    number = lambda r, c: F.shiftleft(F.col("f").cast("long"), 44) + F.shiftleft(F.col(r).cast("long") + 1, 22) + F.col(c) + 1
    named = on.withColumn("id", number("r", "c"))
    there = named.select("f", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("id").alias("b"))
    sent = named.select("f", F.col("id").alias("a"), "r", "c", _steps(RING[2:6])).select("f", "a", (F.col("r") + F.col("s.i")).alias("r2"), (F.col("c") + F.col("s.j")).alias("c2"))
    found = components(sent.join(there, ["f", "r2", "c2"]).select("a", "b"), "edge-links")
    return named.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component", "id")


def closed(on: DataFrame, size: int) -> DataFrame:
    """Pixels (f, r, c) with gaps of less than size closed: grown by a square of that side and shrunk again."""
    cells = [(i, j) for i in range(-(size // 2), (size + 1) // 2) for j in range(-(size // 2), (size + 1) // 2)]
    grown = on.select("f", "r", "c", _steps(cells)).select("f", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()
    back = grown.select("f", "r", "c", _steps(cells)).groupBy("f", (F.col("r") - F.col("s.i")).alias("r"), (F.col("c") - F.col("s.j")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return back.where(F.col("n") == len(cells)).select("f", "r", "c")


def thinned(on: DataFrame) -> DataFrame:
    """Pixels (f, r, c) peeled to lines: in turn from the lower right and the upper left, those go that have two to six neighbours, in one row around them, and an open side there."""
    rows = staged(on.select("f", "r", "c").distinct(), "thin")
    while True:
        gone = 0
        for side in (0, 1):
            near = around(rows.withColumn("v", F.lit(1)), ["v"])
            p = [F.coalesce(F.get("n_v", F.lit(k)), F.lit(0)) for k in range(8)]
            many = sum(p[1:], p[0])
            begins = sum(((1 - p[k]) * p[(k + 1) % 8] for k in range(1, 8)), (1 - p[0]) * p[1])
            up, right, down, left = p[0], p[2], p[4], p[6]
            is_open = (up * right * down == 0) & (right * down * left == 0) if side == 0 else (up * right * left == 0) & (up * down * left == 0)
            peel = many.between(2, 6) & (begins == 1) & is_open
            marked = near.select("f", "r", "c", peel.alias("peel"))
            state, seen = staged_and_seen(marked, "thin", F.count_if("peel").alias("peel"))
            rows, gone = state.where("not peel").select("f", "r", "c"), gone + seen["peel"]
        if not gone:
            return rows


def label_edges(pixels: DataFrame, sigma: float = 2.0, closing: int = 0, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """(f, r, c, label): lines along the edges of segments, by piece. closing: gaps up to this size are closed first."""
    on = edge_pixels(pixels, sigma, low, high)
    return _pieces(staged(thinned(closed(on, closing) if closing > 1 else on), "lines"))
