"""What the operators of this subpackage share: table reading, staged tables, small Column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfield.checkpoints import shared_dir, staged  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """As staged, in buckets of a column: joins on it read the table as it lies, without a shuffle.

    df should come partitioned by the column, else every task writes a file for every bucket. The session's catalog
    knows the table only until it is resolved here; its files stay in the shared folder.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """A block in which Python tasks get their rows in Arrow batches of about so many bytes at most (a longer row is a batch of its own).

    What they return is written or collected inside: the session's own setting is back at the end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its counted rows are within a bound, else as it is."""
    return F.broadcast(df) if rows <= most else df
