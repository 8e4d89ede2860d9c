"""All pairs of frames that are paired block by block."""

import itertools

from pyspark.sql import functions as F

from pathfield.operators import spatial


def test_blocks_meet_each_other_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRED", 10)
    dots = spark.range(70).selectExpr("cast(id % 4 > 0 as int) as f", "id", "cast(id as double) as x", "0D as y")
    frames = [[i for i in range(70) if (i % 4 > 0) == k] for k in (0, 1)]
    for ordered, form in ((False, itertools.combinations), (True, itertools.permutations)):
        found = spatial.pairs(dots, ordered=ordered).select("f", "id1", "id2", "d").collect()
        assert sorted(map(tuple, found)) == sorted((k, a, b, float(abs(a - b))) for k in (0, 1) for a, b in form(frames[k], 2))


def test_a_large_frame_is_dealt_over_tasks(spark):
    """One frame of 9,000 dots: 40 million pairs, which one task formed."""
    dots = spark.range(9000).selectExpr("0 as f", "id", "cast(id as double) as x", "0D as y")
    met = spatial.pairs(dots).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in met) == 9000 * 8999 // 2
    assert len(met) > 1
