"""Edge labels of synthetic disks against plain arrays."""

import numpy as np
import pandas as pd

from pathfield.operators import edges


def plain(v, sigma, low, high, closing):
    n = int(4 * sigma + 0.5)
    k = np.exp(-np.arange(-n, n + 1) ** 2 / (2 * sigma * sigma))
    for axis in (0, 1):
        ones = np.apply_along_axis(lambda x: np.convolve(x, k, "full")[n : n + len(x)], axis, np.ones_like(v))
        v = np.apply_along_axis(lambda x: np.convolve(x, k, "full")[n : n + len(x)], axis, v) / ones
    h, w = v.shape
    gr, gc = np.zeros((h, w)), np.zeros((h, w))
    for r in range(1, h - 1):
        for c in range(1, w - 1):
            gr[r, c] = v[r + 1, c - 1 : c + 2] @ [1, 2, 1] - v[r - 1, c - 1 : c + 2] @ [1, 2, 1]
            gc[r, c] = v[r - 1 : r + 2, c + 1] @ [1, 2, 1] - v[r - 1 : r + 2, c - 1] @ [1, 2, 1]
    m = np.hypot(gr, gc)
    weak = np.zeros((h, w), bool)
    for r in range(1, h - 1):
        for c in range(1, w - 1):
            a, b = abs(gr[r, c]), abs(gc[r, c])
            s, t = (1 if g[r, c] >= 0 else -1 for g in (gr, gc))
            f = min(a, b) / max(a, b) if max(a, b) else 0
            near = [(m[r + x * s, c] if a >= b else m[r, c + x * t]) * (1 - f) + m[r + x * s, c + x * t] * f for x in (1, -1)]
            weak[r, c] = m[r, c] > low and all(m[r, c] >= y - 1e-12 for y in near)
    labels = pieces(weak)
    keep = {labels[r, c] for r, c in zip(*np.where(weak & (m > high)), strict=True)}
    on = np.isin(labels, list(keep)) & weak
    if closing > 1:
        lo, hi = closing // 2, (closing + 1) // 2
        box = [(i, j) for i in range(-lo, hi) for j in range(-lo, hi)]
        grown = {(r + i, c + j) for r, c in zip(*np.where(on), strict=True) for i, j in box}
        on = np.zeros_like(on)
        for r in range(h):
            for c in range(w):
                on[r, c] = all((r + i, c + j) in grown for i, j in box)
    return pieces(thin(on))


def thin(on):
    on = np.pad(on.astype(int), 1)
    while True:
        gone = 0
        for side in (0, 1):
            peel = []
            for r, c in zip(*np.where(on), strict=True):
                p = [on[r + i, c + j] for i, j in edges.RING]
                up, right, down, left = p[0], p[2], p[4], p[6]
                ok = not (up * right * down or right * down * left) if side == 0 else not (up * right * left or up * down * left)
                if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1 and ok:
                    peel.append((r, c))
            for r, c in peel:
                on[r, c] = 0
            gone += len(peel)
        if not gone:
            return on[1:-1, 1:-1].astype(bool)


def pieces(on):
    label = np.full(on.shape, -1)
    for k, (r, c) in enumerate(zip(*np.where(on), strict=True)):
        if label[r, c] < 0:
            stack = [(r, c)]
            label[r, c] = k
            while stack:
                y, x = stack.pop()
                for i, j in edges.RING:
                    if 0 <= y + i < on.shape[0] and 0 <= x + j < on.shape[1] and on[y + i, x + j] and label[y + i, x + j] < 0:
                        label[y + i, x + j] = k
                        stack.append((y + i, x + j))
    return label


def test_outlines_of_disks(spark):
    r, c = np.mgrid[:34, :38]
    rng = np.random.default_rng(1)
    images = {}
    for f, disks in {0: [(10, 10, 6), (22, 26, 7)], 1: [(16, 18, 9)]}.items():
        v = np.zeros(r.shape)
        for y, x, size in disks:
            v[np.hypot(r - y, c - x) <= size] = 1
        images[f] = np.clip(v + rng.normal(0, 0.02, v.shape), 0, 1)
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"f": f, "r": r.ravel(), "c": c.ravel(), "v": v.ravel()}) for f, v in images.items()]))
    for closing in (0, 3):
        got = edges.label_edges(d, 1.5, closing).toPandas()
        for f, v in images.items():
            want = plain(v, 1.5, 0.1, 0.2, closing)
            mine = got[got["f"] == f]
            assert {(a, b) for a, b in zip(mine["r"], mine["c"], strict=True)} == set(zip(*np.where(want >= 0), strict=True))
            groups = lambda rows: {frozenset(x) for x in rows}
            assert groups(set(zip(g["r"], g["c"], strict=True)) for _, g in mine.groupby("label")) == groups(set(zip(*np.where(want == k), strict=True)) for k in set(want[want >= 0]))
        assert got.groupby("f")["label"].nunique().tolist() == [2, 1]
    assert edges.label_edges(d.limit(0)).count() == 0
