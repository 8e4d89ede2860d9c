"""Corners at an angle against all pairs of corners, and dots with more corners than pairs of them fit anywhere."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from pathfield.operators.orient import match_corners


def plain(dots, corners, rc, drc, nc, angle, dangle, rank_by):
    """{id: corner ids} by all pairs of each dot's corners."""
    out = {}
    for f, i, x, y in dots:
        near = [(c, math.hypot(u - x, v - y), math.atan2(v - y, u - x)) for g, c, u, v in corners if g == f and abs(math.hypot(u - x, v - y) - rc) < drc]
        pairs = []
        for (c, _, a), (e, _, b) in itertools.combinations(sorted(near), 2):
            off = round(abs(abs((b - a + math.pi) % (2 * math.pi) - math.pi) - angle), 9)
            if dangle is None or off < dangle:
                pairs.append((off, c, e))
        if rank_by == "ang":
            pairs = sorted(pairs)[: nc - 1]
        legal = {c for _, *both in pairs for c in both}
        if rank_by == "ang" and len(legal) > nc:
            legal = set()
        best = sorted((round(abs(d - rc), 9), c) for c, d, _ in near if c in legal)[:nc]
        if len(best) == nc:
            out[i] = [c for _, c in best]
    return out


CASES = [(2, 1.5, 0.3, "rc"), (2, 1.5, None, "ang"), (3, 1.5, None, "ang"), (4, math.pi / 2, 0.2, "ang"), (3, 0.0, 0.01, "rc"), (2, math.pi, None, "ang"), (3, 4.0, 1.2, "rc"), (2, -0.5, None, "ang")]


@pytest.mark.parametrize("nc, angle, dangle, rank_by", CASES)
@pytest.mark.parametrize("kind", ["random", "lattice", "copies"])
def test_corners_as_by_all_pairs(spark, nc, angle, dangle, rank_by, kind):
    random = np.random.default_rng(3)
    n = 160
    x, y = random.uniform(-1, 1, (2, n))
    if kind == "lattice":
        x, y = np.repeat(np.arange(-4, 4), 20) / 4, np.tile(np.arange(20), 8) / 10 - 1
    if kind == "copies":
        x, y = np.tile(x[:40], 4), np.tile(y[:40], 4)
    f = np.arange(n) % 2
    ids = random.permutation(n) + 100
    corners = list(zip(f.tolist(), ids.tolist(), x.tolist(), y.tolist(), strict=True))
    dots = [(k % 2, k, *random.uniform(-1, 1, 2).tolist()) for k in range(24)]
    dots[0] = (0, 0, 0.05, 0.05)
    expected = plain(dots, corners, 0.5, 0.2, nc, angle, dangle, rank_by)
    found = match_corners(spark.createDataFrame(dots, "f int, id long, x double, y double"), spark.createDataFrame(corners, "f int, id long, x double, y double"), 0.5, 0.2, nc, angle, dangle, rank_by)
    places = {c: (u, v) for _, c, u, v in corners}
    rows = {r["id"]: [tuple(c) for c in r["corner"]] if r["corner"] else None for r in found.collect()}
    assert rows == {k: [places[c] for c in expected[k]] if k in expected else None for _, k, *_ in dots}


@pytest.mark.parametrize("dangle", [0.3, None])
def test_many_corners_of_one_dot(spark, dangle):
    """40,000 corners, 800 million pairs of them."""
    n = 40_000
    turn = np.random.default_rng(5).uniform(0, 2 * math.pi, n)
    corners = spark.createDataFrame(pd.DataFrame({"f": 0, "id": np.arange(n), "x": 0.1 * np.cos(turn), "y": 0.1 * np.sin(turn)}))
    dots = spark.createDataFrame([(0, 0, 0.0, 0.0)], "f long, id long, x double, y double")
    (row,) = match_corners(dots, corners, 0.1, 0.05, 2, 1.5, dangle).collect()
    a, b = (math.atan2(c["y"], c["x"]) for c in row["corner"])
    assert dangle or abs(abs((b - a + math.pi) % (2 * math.pi) - math.pi) - 1.5) < 1e-6
