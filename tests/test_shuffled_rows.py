"""What operators on pairs shuffle: rows in proportion to the dots, however many pairs these form."""

import numpy as np
import pandas as pd
import pytest

from pathfield.operators import fit, spatial


def shuffled(spark, df):
    """(rows that the tasks write for shuffles, the result)."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    found = df().toPandas()
    return sum(n for k, n in written().items() if k not in before), found


@pytest.fixture(scope="module")
def crowd(spark):
    """1,200 dots of one frame, which form 700,000 pairs."""
    random = np.random.default_rng(1)
    x, y = random.uniform(0, 0.3, (2, 1200))
    return spark.createDataFrame(pd.DataFrame({"f": np.zeros(1200, int), "id": np.arange(1200), "x": x, "y": y})), x, y


def test_pair_distribution_adds_up_where_pairs_are_formed(spark, crowd):
    dots, x, y = crowd
    rows, found = shuffled(spark, lambda: spatial.pair_distribution(dots, 20, 0.4, 0.05, 0.05))
    assert rows < 50_000
    d0 = np.hypot(x - (x.min() + x.max()) / 2, y - (y.min() + y.max()) / 2)
    rs = d0.max() + 0.025
    i, j = np.triu_indices(len(x), 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    keep = (d > 0) & (d <= 0.4)
    i, j, d = i[keep], j[keep], d[keep]
    weight = lambda c: np.where(c <= rs - 0.05, 1 / (2 * np.arccos(np.maximum(-1, (d * d + c * c - rs * rs) / (2 * d * c))) * d * 0.02), 0)
    g = np.bincount(np.minimum(d // 0.02, 19).astype(int), (weight(d0[i]) + weight(d0[j])) / (d0 <= rs - 0.05).sum(), 20)
    assert found.sort_values("bin")["g"].tolist() == pytest.approx(g[g > 0].tolist())


def test_peak_decay_adds_up_where_pairs_are_formed(spark, crowd):
    g = lambda: spatial.pair_distribution(crowd[0], 40, 0.6, 0.0, 0.02).selectExpr("f", "(bin + 0.5) * 0.015 as r", "g")
    rows, found = shuffled(spark, lambda: fit.peak_decay(g(), "r", "g", "f", lookahead=1))
    assert rows < 50_000
    # tests/test_fits.py has known curves
    assert found.columns.tolist() == ["f", "param", "value", "stderr"]
