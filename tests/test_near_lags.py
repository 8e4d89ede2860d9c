"""Pairs of rows at near lags against all pairs, and what they shuffle."""

import numpy as np
import pandas as pd
import pytest

from pathfield.operators import lag
from tests.test_shuffled_rows import shuffled


@pytest.mark.parametrize("max_lag", [0, 1, 7, 40])
@pytest.mark.parametrize("two_sided", [False, True])
def test_near_pairs_as_by_all_pairs(spark, max_lag, two_sided):
    random = np.random.default_rng(4)
    # gaps, negative frames and repeated ones
    tracks = pd.DataFrame({"t": random.integers(0, 3, 300), "f": random.integers(-60, 60, 300).astype("int32"), "x": np.arange(300.0)})
    both = tracks.merge(tracks, on="t", suffixes=("1", "2"))
    tau = both["f2"] - both["f1"]
    both = both[(tau <= max_lag) & (tau >= (-max_lag if two_sided else 0))]
    pairs = lambda: lag.lag_pairs(spark.createDataFrame(tracks), ["x"], max_lag, two_sided=two_sided)
    rows, found = shuffled(spark, pairs)
    assert rows <= 4 * len(tracks)
    key = lambda *c: sorted(zip(*[v.tolist() for v in c], strict=True))
    assert key(found["t"], found["f"], found["tau"], found["x1"], found["x2"]) == key(both["t"], both["f1"], both["f2"] - both["f1"], both["x1"], both["x2"])
