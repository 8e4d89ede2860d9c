"""Joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_counts(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """df with the number of rows of each key: a partial aggregate and a join, which a hot key does not gather in one task."""
    keys = [key] if isinstance(key, str) else key
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def joined_stats(df: DataFrame, key: str, **stats: Column) -> DataFrame:
    """df with aggregates of each key's rows beside them: partial aggregates and a join with one row a key, which no key gathers in one task. Rows without the key are left out."""
    return df.join(df.groupBy(key).agg(*[c.alias(n) for n, c in stats.items()]), key)
