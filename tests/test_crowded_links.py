"""Parents among crowded dots against all pairs, and what their search shuffles."""

import math

import numpy as np
import pandas as pd
import pytest

from pathfield.operators import linking
from tests.test_shuffled_rows import shuffled


def plain(dots, reach, giveup):
    """{id: parent} by all pairs of frames."""
    out = {}
    frames = {f: d.sort_values("id") for f, d in dots.groupby("f")}
    far = lambda a, b: np.sqrt((a["x"].to_numpy()[:, None] - b["x"].to_numpy()) ** 2 + (a["y"].to_numpy()[:, None] - b["y"].to_numpy()) ** 2)
    for f, d in frames.items():
        for n in range(1, giveup + 1):
            if f - n not in frames:
                continue
            old = frames[f - n]
            m = far(d, old)
            for k in range(len(d)):
                i = int(d["id"].iloc[k])
                if i in out or m[k].min() >= reach * math.sqrt(n):
                    continue
                p = int(m[k].argmin())
                good = m[k, p] <= m[:, p].min() and not d["cut"].iloc[k] and not old["cut"].iloc[p]
                out[i] = int(old["id"].iloc[p]) if good else None
    return {int(i): out.get(int(i)) for i in dots["id"]}


@pytest.mark.parametrize("kind", ["clusters", "copies", "grid"])
def test_parents_as_by_all_pairs(spark, kind):
    random = np.random.default_rng(2)
    n = 900
    # a crowd, a cloud and a few far off: searches go through cells of several sizes
    spread = np.repeat([0.05, 3.0, 60.0], [400, 400, 100])
    x, y = random.normal(0, 1, (2, n)) * spread
    if kind == "copies":
        x, y = np.tile(x[::9], 9), np.tile(y[::9], 9)
    if kind == "grid":
        x, y = random.integers(-12, 12, n) / 10, random.integers(-12, 12, n).astype(float)
    dots = pd.DataFrame({"id": random.permutation(n) + 5, "f": np.sort(random.integers(0, 5, n)) if kind != "copies" else np.repeat(np.arange(5), 180), "x": x, "y": y, "cut": random.uniform(size=n) < 0.2})
    found = {r.id: r.parent for r in linking.parents(spark.createDataFrame(dots), 2.0, 3, "cut").collect()}
    assert found == plain(dots, 2.0, 3)
    assert sum(p is not None for p in found.values()) > 20


def test_equal_places_are_searched_once(spark):
    """Two frames of 1,500 dots at one place each: 2 million pairs in reach."""
    dots = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "f": np.repeat([0, 1], 1500), "x": 1.0, "y": 2.0}))
    rows, found = shuffled(spark, lambda: linking.parents(dots, 2.0, 3))
    assert rows < 100_000
    assert set(found[found["f"] == 1]["parent"]) == {0} and found[found["f"] == 0]["parent"].isna().all()


@pytest.mark.parametrize("stub", [0, 3])
def test_labels_of_equal_places(spark, stub):
    dots = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "f": np.repeat([0, 1], 1500), "x": 1.0, "y": 2.0}))
    rows, found = shuffled(spark, lambda: linking.track_labels(dots, 2.0, 3, stub=stub))
    assert rows < 100_000
    labels = found.set_index("id")["t"]
    assert (labels[labels.index >= 1500] == 0).all() and labels[0] == 0 and labels[1499] == (-1 if stub else 1499)
