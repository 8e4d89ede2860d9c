"""Orientation of dots from the corners around them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_corners(
    dots: DataFrame, corners: DataFrame, rc: float, drc: float | None = None, nc: int = 2, angle: float | None = None, dangle: float | None = None, rank_by: str = "rc", average: bool = True
) -> DataFrame:
    """(f, id, orient, corner, cdisp): every dot, with NULLs where fewer than nc corners lie within rc +- drc of it.

    angle: only corners that some other one is seen at this angle from, within dangle, count; without dangle, or with rank_by 'ang',
    the nc - 1 pairs nearest to the angle are taken, and a dot whose pairs have more than nc corners has none. Else the nc corners whose
    distance is nearest to rc count (ties by id). The orientation is that of the sum of unit vectors to them, or, not average, each
    corner's own, as an array. drc: sqrt(rc) by default. A join on (frame, cell), cells being as large as the longest distance; with an angle, the dots of a cell meet the corners of
    the nine cells around them in one task.
    """
    drc = drc or math.sqrt(rc)
    size = rc + drc
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = dots.select("f", "id", "x", "y").withColumns({"cx": cell("x"), "cy": cell("y")})
    b = corners.select("f", F.col("id").alias("cid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(around).alias("k"))
    b = b.select("f", "cid", "qx", "qy", (cell("qx") + F.col("k.i")).alias("cx"), (cell("qy") + F.col("k.j")).alias("cy"))
    d = F.hypot(F.col("qx") - F.col("x"), F.col("qy") - F.col("y"))
    if angle is None:
        near = a.join(b, ["f", "cx", "cy"]).withColumn("d", d).where(F.abs(F.col("d") - rc) < drc).drop("cx", "cy")
    else:
        near = _at_angle(a, b, rc, drc, nc, angle, dangle, "ang" if dangle is None else rank_by)
    rank = F.row_number().over(Window.partitionBy("f", "id").orderBy(F.round(F.abs(F.col("d") - rc), 9), "cid"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= nc)
    mean = F.pmod(F.atan2(F.sum((F.col("qy") - F.col("y")) / F.col("d")), F.sum((F.col("qx") - F.col("x")) / F.col("d"))), F.lit(2 * math.pi))
    own = F.pmod(F.atan2(F.col("qy") - F.col("y"), F.col("qx") - F.col("x")), F.lit(2 * math.pi))
    members = F.sort_array(F.collect_list(F.struct("rank", "qx", "qy", "d", own.alias("own"))))
    found = best.groupBy("f", "id").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), members.alias("m")).where(F.col("n") >= nc)
    orient = F.col("mean") if average else F.transform("m", lambda c: c["own"])
    found = found.select("f", "id", orient.alias("orient"), F.transform("m", lambda c: F.struct(c["qx"].alias("x"), c["qy"].alias("y"))).alias("corner"), F.transform("m", lambda c: c["d"]).alias("cdisp"))
    return dots.select("f", "id").join(found, ["f", "id"], "left")


def _at_angle(a: DataFrame, b: DataFrame, rc: float, drc: float, nc: int, angle: float, dangle: float | None, rank_by: str) -> DataFrame:
    """(f, id, x, y, cid, qx, qy, d) of the nc corners nearest to rc that the pair angles leave each dot. a: dots, b: corners, by (f, cx, cy), the corners in all cells from which they may be in reach."""
    kinds = dict(a.dtypes) | dict(b.dtypes)

    def best(dots: pd.DataFrame, corners: pd.DataFrame) -> pd.DataFrame:
        qx, qy, code = corners["qx"].to_numpy(float), corners["qy"].to_numpy(float), np.unique(corners["cid"].to_numpy(), return_inverse=True)[1]
        dot, corner, far = [], [], []
        for k, (x, y) in enumerate(zip(dots["x"].to_numpy(float), dots["y"].to_numpy(float), strict=True)):
            d = np.hypot(qx - x, qy - y)
            near = np.flatnonzero(np.abs(d - rc) < drc)
            seen = np.arctan2(qy[near] - y, qx[near] - x)
            near = near[np.argsort(seen)]
            seen = np.sort(seen)
            left = near[_of_best_pairs(seen, code[near], angle, dangle, nc) if rank_by == "ang" else _has_other(seen, code[near], angle, dangle)]
            left = left[np.lexsort((code[left], _digits(np.abs(d[left] - rc))))][:nc]
            dot += [k] * len(left)
            corner += left.tolist()
            far += d[left].tolist()
        first, second = dots.iloc[dot].reset_index(drop=True), corners.iloc[corner].reset_index(drop=True)
        return pd.concat([first[["f", "id", "x", "y"]], second[["cid", "qx", "qy"]], pd.Series(far, dtype=float, name="d")], axis=1)

    keys = ["f", "cx", "cy"]
    # the number is given, else few MB of dots would be put into few tasks
    many = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [s.dropna().repartition(many, *keys).groupBy(*keys) for s in (a, b)]
    return sides[0].cogroup(sides[1]).applyInPandas(best, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in ("f", "id", "x", "y", "cid", "qx", "qy", "d")))


def _digits(v: np.ndarray) -> np.ndarray:
    """Values in units of the ninth digit, by which differences of angles and of distances are compared."""
    return np.floor(v * 1e9 + 0.5)


def _off(seen: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray, angle: float) -> np.ndarray:
    """How far the angle from one corner to another is off, in units of the ninth digit; endless for a corner and itself."""
    turn = np.where(code[j] > code[i], seen[j] - seen[i], seen[i] - seen[j])
    turn = np.fmod(np.fmod(turn + math.pi, 2 * math.pi) + 2 * math.pi, 2 * math.pi) - math.pi
    return np.where(i == j, np.inf, _digits(np.abs(np.abs(turn) - angle)))


def _has_other(seen: np.ndarray, code: np.ndarray, angle: float, dangle: float) -> np.ndarray:
    """Places of the corners that some other one is seen at the angle from. seen: angles in order; the nearest ones to either side of the angle decide."""
    m = len(seen)
    i, turned, least = np.arange(m)[:, None], min(max(angle, 0.0), math.pi), np.full(m, np.inf)
    if m < 2:
        return i[:0, 0]
    around = np.concatenate([seen - 2 * math.pi, seen, seen + 2 * math.pi])
    for t in (turned, -turned):
        j = (np.searchsorted(around, seen + t)[:, None] + np.arange(-2, 2)) % m
        least = np.minimum(least, _off(seen, code, i, j, angle).min(1))
    return np.flatnonzero(least / 1e9 < dangle)


def _of_best_pairs(seen: np.ndarray, code: np.ndarray, angle: float, dangle: float | None, nc: int) -> np.ndarray:
    """Places of the corners in the nc - 1 pairs nearest to the angle, ties by codes; none if these have more than nc corners.

    The corners next to each one's angle give the offset up to which pairs count; of those at this offset, of which there may be many, the ones of the least codes are taken.
    """
    m, k = len(seen), nc - 1
    none = np.arange(0)
    if m < 2 or k < 1:
        return none
    turned = min(max(angle, 0.0), math.pi)
    around = np.concatenate([seen - 2 * math.pi, seen, seen + 2 * math.pi])
    i = np.arange(m)[:, None]
    j = np.broadcast_to(np.arange(m), (m, m)) if 2 * k + 2 >= m else (np.searchsorted(around, seen + turned)[:, None] + np.arange(-k - 1, k + 1)) % m
    off = _off(seen, code, i, j, angle)
    # a pair may be met from both sides
    some = np.argpartition(off.ravel(), min(2 * k, off.size) - 1)[: 2 * k]
    at, other = some // off.shape[1], j.ravel()[some]
    pairs = sorted({(o, *sorted((p, q))) for o, p, q in zip(off.ravel()[some].tolist(), code[at].tolist(), code[other].tolist(), strict=True) if o < np.inf})
    if len(pairs) >= k:
        last = pairs[k - 1][0]
        pairs = [p for p in pairs if p[0] < last]
        reach = max(last / 1e9 - abs(angle - turned), 0.0) + 0.5e-9 + 1e-12
        low, high = ([np.searchsorted(around, seen + t + s * reach, side) for t in (turned, -turned)] for s, side in ((-1, "left"), (1, "right")))
        tied = np.flatnonzero((high[0] > low[0]) | (high[1] > low[1]))
        for a in tied[np.argsort(code[tied])]:
            b = np.unique(np.concatenate([np.arange(lo[a], min(hi[a], lo[a] + m)) % m for lo, hi in zip(low, high, strict=True)]))
            b = b[code[b] > code[a]]
            b = b[_off(seen, code, a, b, angle) == last]
            pairs += [(last, int(code[a]), c) for c in np.sort(code[b])[: k - len(pairs)].tolist()]
            if len(pairs) >= k:
                break
    found = np.unique([c for o, *both in pairs if dangle is None or o / 1e9 < dangle for c in both])
    return np.flatnonzero(np.isin(code, found)) if 0 < len(found) <= nc else none
