"""Synthetic tracks of active walkers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*key: Column | int) -> Column:
    """A number in (0, 1) fixed by its key, however the rows are partitioned: the first 13 hex digits of the MD5 of the key's parts."""
    text = F.concat_ws("|", *[(F.lit(k) if isinstance(k, int) else k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def hashed_normal(*key: Column | int) -> Column:
    """A standard normal number fixed by its key."""
    return F.sqrt(-2 * F.ln(uniform(*key, 1))) * F.cos(2 * math.pi * uniform(*key, 2))


def walkers(spark: SparkSession, tracks: int, size: int, dr: float, dt: float, v0: float, w0: float = 0.0, seed: int = 0) -> DataFrame:
    """Track rows: orientations and places as running sums of turning noise (mean w0) and of speed v0 along o with noise."""
    rows = spark.range(tracks).select(F.col("id").alias("t")).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    n = lambda k: hashed_normal(F.col("t"), F.col("f"), seed * 8 + k)
    w = Window.partitionBy("t").orderBy("f")
    o = F.sum(w0 + math.sqrt(2 * dr) * n(1)).over(w) + 2 * math.pi * uniform(F.col("t"), seed, 0)
    rows = rows.withColumn("o", o)
    along, across = v0 + math.sqrt(2 * dt) * n(2), math.sqrt(2 * dt) * n(3)
    rows = rows.withColumns({"vx": along * F.cos("o") - across * F.sin("o"), "vy": along * F.sin("o") + across * F.cos("o")})
    return rows.select((F.col("t") * size + F.col("f") + 1).alias("id"), "f", "t", F.sum("vx").over(w).alias("x"), F.sum("vy").over(w).alias("y"), "o")
