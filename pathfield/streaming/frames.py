"""Streaming forms: statistics of each window of event time, late rows tolerated up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_order(dots: DataFrame, ts: str, window: str, late: str, m: int = 4) -> DataFrame:
    """(start, n, phi): dots and molecular order of each window; works on batches and streams alike."""
    g = dots.withWatermark(ts, late).groupBy(F.window(ts, window))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.cos(m * F.col("o"))).alias("re"), F.avg(F.sin(m * F.col("o"))).alias("im"))
    return out.select(F.col("window.start").alias("start"), "n", F.hypot("re", "im").alias("phi"))
