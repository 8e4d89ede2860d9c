"""Record shapes. All operators name columns as in these schemas unless told otherwise.

A dot is a row (f frame, x, y, id); a track row adds t (track, -1 for none) and o (orientation, radians). Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIONS = "f int, x double, y double, lab int, ecc double, area int, id bigint"
TRACKS = "id bigint, f int, t int, x double, y double, o double"
ORIENTATION = "id bigint, corner array<struct<x:double,y:double>>, orient double, cdisp array<double>"
VELOCITY = "o double, v double, x double, y double, par double, perp double, eta double, etax double, etay double, etapar double"
MELT = "id bigint, f int, t int, sh int, r double, dens double, psi double, phi double"
META = "source string, key string, value string"
FITS = "dataset string, func string, param string, value double"


def nulls(df: DataFrame) -> DataFrame:
    """NaN in floating columns to NULL."""
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def as_tracks(dots: DataFrame, track: int = -1) -> DataFrame:
    """Dots as track rows without a track or orientation."""
    return dots.select("id", "f", F.lit(track).alias("t"), "x", "y", F.lit(None).cast("double").alias("o"))
