"""k nearest and Voronoi neighbours against brute force, in even, clustered and degenerate frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathfield.operators import spatial


def brute(d, k):
    out = set()
    for f, g in d.groupby("f"):
        x, y, i = (g[c].to_numpy() for c in ("x", "y", "id"))
        for n in range(len(g)):
            r = np.hypot(x - x[n], y - y[n])
            order = [m for m in np.lexsort((i, r)) if m != n][:k]
            out |= {(f, i[n], i[m], rank) for rank, m in enumerate(order, 1)}
    return out


def frames():
    rng = np.random.default_rng(8)
    even = rng.random((300, 2))
    spot = np.concatenate([rng.random((60, 2)) * 1000, 500 + rng.random((900, 2)) * 1e-3])
    far = np.concatenate([[[0, 0], [1e6, 3], [5, 9e5]], 77 + rng.random((700, 2))])
    same = np.concatenate([np.repeat([[3.0, 4.0]], 800, 0), rng.random((50, 2)) * 9])
    line = np.stack([rng.random(400), np.zeros(400)], 1)
    lattice = np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), -1).reshape(-1, 2)
    few = np.array([[0.0, 0.0], [1.0, 1.0]])
    parts = {0: even, 1: spot, 2: far, 3: same, 4: line, 5: lattice, 6: few, 7: few[:1]}
    return pd.concat([pd.DataFrame({"f": f, "id": rng.permutation(len(p)) + 10_000 * f, "x": p[:, 0], "y": p[:, 1]}) for f, p in parts.items()])


@pytest.mark.parametrize(("which", "small"), [([0, 4, 5, 6, 7], 9_999), ([0, 4, 5, 6, 7], 1), ([0, 1, 2, 3, 4, 5, 6, 7], 1)])
def test_nearest(spark, which, small, monkeypatch):
    monkeypatch.setattr(spatial, "SMALL", small)
    d = frames()
    d = d[d["f"].isin(which)]
    dots = spark.createDataFrame(d)
    for k in (1, 4):
        got = {(r.f, r.id1, r.id2, r.rank) for r in spatial.knn(dots, k).select("f", "id1", "id2", "rank").collect()}
        expected = brute(d, k)
        assert {x for x in got ^ expected if x[0] != 5} == set()
        # on a lattice, sums of squares decide ties in the last bit
        assert {(x[1], x[3]) for x in got if x[0] == 5} == {(x[1], x[3]) for x in expected if x[0] == 5}


def test_crowded_frames_stay_linear(spark):
    """A frame with 90 % of its dots in one spot: the pairs that are looked at grow with the dots, not with their square."""
    made = []
    for n in (1_000, 4_000):
        rng = np.random.default_rng(n)
        p = np.concatenate([rng.random((n // 10, 2)) * 1000, 500 + rng.random((9 * n // 10, 2)) * 1e-2])
        dots = spark.createDataFrame(pd.DataFrame({"f": 0, "id": np.arange(n), "x": p[:, 0], "y": p[:, 1]}))
        box = dots.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
        made.append(spatial._searched(spatial._side(dots, "1", []), dots, 4, [], box, True).count())
    assert made[1] < 6 * made[0] and made[1] < 400 * 4_000


def edges(p):
    """Neighbours and areas from the interval that all others leave of each pair's bisector."""
    n, out, area = len(p), {}, []
    for i in range(n):
        opened, total = False, 0.0
        for j in range(n):
            if i == j:
                continue
            d = p[j] - p[i]
            size = np.hypot(*d)
            mid, u = (p[i] + p[j]) / 2, np.array([-d[1], d[0]]) / size
            lo, hi = -np.inf, np.inf
            for k in range(n):
                if k in (i, j):
                    continue
                c, r = (p[k] - p[i]) @ u, (p[k] @ p[k] - p[i] @ p[i]) / 2 - (p[k] - p[i]) @ mid
                if abs(c) > 1e-12:
                    lo, hi = (lo, min(hi, r / c)) if c > 0 else (max(lo, r / c), hi)
                elif r < -1e-12:
                    hi = -np.inf
            if hi - lo > 1e-9:
                out[i, j] = hi - lo
                opened |= np.isinf(hi - lo)
                total += (hi - lo) * size / 4
        area.append(None if opened or n == 1 else total)
    return out, area


def test_voronoi(spark):
    from pathfield.operators import voronoi

    rng = np.random.default_rng(5)
    a = np.arange(24) * np.pi / 12
    circle = np.concatenate([np.stack([np.cos(a), np.sin(a)], 1), [[0.0, 0.0]]])
    parts = {
        0: rng.random((70, 2)), 1: np.stack(np.meshgrid(np.arange(7.0), np.arange(6.0)), -1).reshape(-1, 2), 2: circle, 3: np.concatenate([rng.random((40, 2)), 5 + rng.random((40, 2)) * 1e-3]),
        4: np.stack([np.arange(6.0), np.zeros(6)], 1), 5: np.array([[1.0, 2.0]]), 6: np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]),
    }
    d = pd.concat([pd.DataFrame({"f": f, "id": np.arange(len(p)) + 1000 * f, "x": p[:, 0], "y": p[:, 1]}) for f, p in parts.items()])
    extra = pd.DataFrame({"f": [0, 9], "id": [99, 9000], "x": [parts[0][3, 0], None], "y": [parts[0][3, 1], None]})
    dots = spark.createDataFrame(pd.concat([d, extra]).astype(object).where(lambda x: x.notna(), None), "f int, id long, x double, y double")
    cells = voronoi.voronoi(dots).cache()
    got = {(r.f, r.id % 1000): r for r in cells.collect()}
    assert len(got) == len(d) + 1 and got[0, 99].area == got[0, 3].area
    for f, p in parts.items():
        lengths, area = edges(p)
        found = {(i, e.id % 1000): e.length for (g, i), r in got.items() if g == f and i != 99 for e in r.edges}
        assert found.keys() == lengths.keys(), f
        assert not {k: (f, found[k], v) for k, v in lengths.items() if np.isfinite(v) and found[k] != pytest.approx(v, rel=1e-5, abs=1e-9)}
        assert [got[f, i].area for i in range(len(p))] == [v if v is None else pytest.approx(v, rel=1e-5) for v in area], f
    pairs = voronoi.voronoi_neighbours(dots.where("f = 1"), cells=cells.where("f = 1")).where("id1 = 1010").orderBy("rank").collect()
    assert [r.id2 for r in pairs] == [1003, 1009, 1011, 1017] and all(r.d == 1 for r in pairs)
    dens = {r.id: r.dens for r in voronoi.voronoi_density(cells.where("f = 1")).collect()}
    assert dens[1000] == 0 and dens[1010] == pytest.approx(1)
    cells.unpersist()


def test_voronoi_of_many(spark):
    """Areas of inner cells and the mutual neighbours of 3,000 dots: Euler's formula bounds the edges."""
    from pathfield.operators import voronoi

    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random((1_500, 2)), 0.5 + rng.random((1_500, 2)) / 50])
    cells = voronoi.voronoi(spark.createDataFrame(pd.DataFrame({"f": 0, "id": np.arange(3_000), "x": p[:, 0], "y": p[:, 1]}))).toPandas()
    pairs = {(i, e["id"]) for i, x in zip(cells["id"], cells["edges"], strict=True) for e in x}
    assert all((b, a) in pairs for a, b in pairs)
    opened = int(cells["area"].isna().sum())
    assert len(pairs) // 2 == 3 * 3_000 - 3 - opened
