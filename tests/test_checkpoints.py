"""Staged tables go to one folder and can be dropped."""

import os

import pytest

from pathfield import checkpoints
from pathfield.operators import graph


def test_staging_blocks(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    with checkpoints.staging(spark) as path:
        found = graph.components(links)
        assert found.where("component = 0").count() == 31 and len(os.listdir(path)) > 2
        with checkpoints.staging(spark) as inner:
            assert inner.startswith(path) and checkpoints.staged(links, "x").count() == 30 and os.path.isdir(inner)
        assert not os.path.exists(inner) and os.path.isdir(path)
    assert not os.path.exists(path)
    with pytest.raises(ValueError), checkpoints.staging(spark) as path:
        checkpoints.staged(links, "x")
        raise ValueError
    assert not os.path.exists(path) and not checkpoints._runs[spark.sparkContext.applicationId]


def test_dropping_all(spark):
    """Inside a block, so that other tests' tables stay."""
    with checkpoints.staging(spark) as path:
        assert checkpoints.staged(spark.range(5), "five").count() == 5 and os.listdir(path)
        checkpoints.drop_staged(spark)
        assert not os.path.exists(path)
        checkpoints.drop_staged(spark)
        assert checkpoints.staged(spark.range(4), "four").count() == 4
