"""Voronoi cells and Delaunay neighbours within frames.

A dot's cell is what the bisectors with dots nearby leave of a wide square. It is settled when no other dot can reach it: the next dot not met is at least twice as far
as the cell's farthest corner. Cells come from each dot's nearest (`spatial.knn`'s search), in rounds that ask for more of them. Those left over lie at or near the rim, where corners are far
away; as neighbours are so mutually, such a dot's neighbours are settled dots that have it as theirs, or left over as well, and these are all it has to meet.

Defined results: a cell that reaches OPEN times the frame's extent is open, without an area. Neighbours share an edge longer than SHORT of the cell's size, so that dots on one circle are neighbours along
it, not across. Dots at one place have the same cell, the edges of which name the least id at each neighbouring place. A frame's only place has an open cell without neighbours. Dots without a place are left out.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators import spatial

OPEN, SHORT = 1e5, 1e-9
#: Nearest dots met in each round.
ROUNDS = (14, 48)

_NEAR = "array<struct<d:double,id:long,x:double,y:double>>"
_CELL = "f {f}, id long, x double, y double, extent double, settled boolean, area double, edges array<struct<id:long,length:double>>"


def cell(extent: float, near: list[tuple[float, int, float, float]]) -> tuple[list[tuple[float, float, int | None]], float]:
    """Corners (x, y, the neighbour beyond the edge that begins there), relative to the dot, after the bisectors with dots (distance, id, dx, dy) in order, and the farthest corner's distance."""
    b = OPEN * extent
    corners = [(-b, -b, None), (b, -b, None), (b, b, None), (-b, b, None)]
    far = b * math.sqrt(2)
    for d, i, dx, dy in near:
        if d >= 2 * far:
            break
        # inside: nearer to the dot than to the other
        depth = [(dx * x + dy * y) / d - d / 2 for x, y, _ in corners]
        over = [z > 1e-13 * (abs(x) + abs(y) + d) for z, (x, y, _) in zip(depth, corners, strict=True)]
        if not any(over):
            continue
        cut = []
        for k, (x, y, beyond) in enumerate(corners):
            m = (k + 1) % len(corners)
            here, there = over[k], over[m]
            if not here:
                cut.append((x, y, beyond))
            if here != there:
                p, q = corners[k], corners[m]
                w = depth[k] / (depth[k] - depth[m])
                # the bisector's edge begins where the old one goes out, an old one where it comes in
                cut.append((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1]), beyond if here else i))
        corners = cut
        far = max((math.hypot(x, y) for x, y, _ in corners), default=0.0)
    return corners, far


def _cells(complete: bool):
    def run(frames):
        for rows in frames:
            out = []
            for f, i, x, y, extent, all_met, near in zip(*(rows[c] for c in ("f", "id", "x", "y", "extent", "met", "near")), strict=True):
                others = sorted((n["d"], n["id"], n["x"] - x, n["y"] - y) for n in near) if near is not None else []
                corners, far = cell(extent, others)
                settled = complete or all_met or (bool(others) and others[-1][0] >= 2 * far)
                area, edges = 0.0, []
                for k, (a, b, beyond) in enumerate(corners):
                    c, d, _ = corners[(k + 1) % len(corners)]
                    area += (a * d - c * b) / 2
                    size = math.hypot(c - a, d - b)
                    if beyond is not None and size > SHORT * min(far, extent):
                        edges.append({"id": beyond, "length": size})
                opened = not corners or any(beyond is None for *_, beyond in corners)
                out.append((f, i, x, y, extent, settled, None if opened else area, edges))
            yield pd.DataFrame(out, columns=["f", "id", "x", "y", "extent", "settled", "area", "edges"]).astype({"area": "float64"})

    return run


def voronoi(dots: DataFrame) -> DataFrame:
    """(f, id, area, edges) of each dot: its cell's area, NULL if open, and its edges as (neighbour's id, length)."""
    named = dots.where("f is not null and x is not null and y is not null").select("f", F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = staged(named.groupBy("f", "x", "y").agg(F.min("id").alias("id")), "places")
    box = places.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    extent = box.select("f", F.when(F.greatest("w", "h") > 0, F.greatest("w", "h")).otherwise(1.0).alias("extent"), (F.col("n") - 1).alias("others"))
    schema = _CELL.format(f=dict(places.dtypes)["f"])
    left, done = places, None
    for k in ROUNDS:
        order = Window.partitionBy("f", "id1").orderBy("d", "id2")
        found = spatial._searched(spatial._side(left, "1", []), places, k, [], box, True).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        near = found.groupBy("f", F.col("id1").alias("id")).agg(_near("id2", "x2", "y2"))
        rows = left.join(extent, "f").join(near, ["f", "id"], "left").withColumn("met", F.col("others") <= F.coalesce(F.size("near"), F.lit(0)))
        cells = staged(rows.select("f", "id", "x", "y", "extent", "met", "near").mapInPandas(_cells(False), schema), "cells")
        done = cells.where("settled") if done is None else done.unionByName(cells.where("settled"))
        left = cells.where("not settled").select("f", "id", "x", "y")
    # the rest among themselves and with the settled ones that have them as neighbours
    rest = spatial._side(left, "1", []).join(spatial._side(left, "2", []), "f").where("id1 <> id2").select("f", "id1", "id2", "x2", "y2", spatial._distance().alias("d"))
    known = done.select("f", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode("edges.id").alias("id1"))
    known = spatial._side(left, "1", []).join(known, ["f", "id1"]).select("f", "id1", "id2", "x2", "y2", spatial._distance().alias("d"))
    near = rest.unionByName(known).groupBy("f", F.col("id1").alias("id")).agg(_near("id2", "x2", "y2"))
    rows = left.join(extent, "f").join(near, ["f", "id"], "left").withColumn("met", F.lit(True))
    last = rows.select("f", "id", "x", "y", "extent", "met", "near").mapInPandas(_cells(True), schema)
    cells = done.unionByName(last).select("f", "x", "y", "area", "edges")
    return named.select("f", "id", "x", "y").join(cells, ["f", "x", "y"]).select("f", "id", "area", "edges")


def _near(i: str, x: str, y: str):
    return F.collect_list(F.struct("d", F.col(i).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))).alias("near")


def voronoi_neighbours(dots: DataFrame, columns: list[str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Pairs of neighbours, both orders, as from spatial.knn, with rank by distance. cells: from `voronoi`, if known."""
    cells = voronoi(dots) if cells is None else cells
    a, b = (spatial._side(dots, n, columns or []) for n in "12")
    pairs = cells.select("f", F.col("id").alias("id1"), F.explode("edges.id").alias("id2"))
    met = pairs.join(a, ["f", "id1"]).join(b, ["f", "id2"]).withColumn("d", spatial._distance())
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("f", "id1").orderBy("d", "id2")))


def voronoi_density(cells: DataFrame) -> DataFrame:
    """(f, id, dens): one over the cell's area, 0 for open cells."""
    return cells.select("f", "id", F.coalesce(F.try_divide(F.lit(1.0), F.col("area")), F.lit(0.0)).alias("dens"))
