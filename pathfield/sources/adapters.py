"""Track, dot and point tables made from the driver's tables, with their SQL.

Every order ends in a unique key, so that all engines agree on ties.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_values(events: DataFrame) -> dict:
    k = F.get_json_object("props", "$.k").cast("double")
    # the SQL's own operations: a step of half a turn is a tie that the last digit of an angle decides
    turns = ((F.col("value") * 0.1) % 1.0 + 1.0) % 1.0
    return {"id": F.col("event_id"), "x": F.col("value"), "y": k, "o": 2 * math.pi * turns}


def tracks_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a track for each user, a frame for each event in order."""
    e = table(spark, sf_dir, "events")
    f = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return e.select(F.col("user_id").alias("t"), f.alias("f"), *[c.alias(n) for n, c in _event_values(e).items()])


def tracks_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a track for each user, hours since the first event as frames."""
    e = table(spark, sf_dir, "events")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first = e.agg(F.min("ts").alias("t0"))
    f = F.floor((micros("ts") - micros("t0")) / 3_600_000_000).cast("int")
    return e.join(F.broadcast(first)).select(F.col("user_id").alias("t"), f.alias("f"), *[c.alias(n) for n, c in _event_values(e).items()])


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: days since the first event as frames."""
    return tracks_gappy(spark, sf_dir).withColumn("f", F.floor(F.col("f") / 24).cast("int")).drop("t")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a frame for each label, the first two components as place, the next two as direction."""
    e = table(spark, sf_dir, "embeddings")
    c = lambda i: F.get("embedding", i).cast("double")
    return e.select(F.col("label").alias("f"), F.col("vec_id").alias("id"), c(0).alias("x"), c(1).alias("y"), F.atan2(c(3), c(2)).alias("o"))


def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a track for each order, the line number as frame, with repeated ones."""
    items = table(spark, sf_dir, "lineitem")
    key = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return items.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("f"), F.row_number().over(key).cast("long").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a series of log prices for each customer."""
    o = table(spark, sf_dir, "orders")
    f = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    return o.select(F.col("o_custkey").alias("t"), f.alias("f"), F.col("o_orderkey").alias("id"), F.ln("o_totalprice").alias("x"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: an active walker for each user: every event turns it by its value and pushes it on along its direction."""
    w = Window.partitionBy("t").orderBy("f")
    d = tracks_dense(spark, sf_dir).withColumn("o", F.sum((F.pmod("x", F.lit(7.0)) - 3.5) / 8).over(w))
    push = 0.5 + F.pmod("y", F.lit(3.0)) / 20
    return d.withColumns({"x": F.sum(push * F.cos("o")).over(w), "y": F.sum(push * F.sin("o")).over(w)})


_VALUES = "event_id AS id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, 2 * pi() * (((value * 0.1) % 1.0 + 1.0) % 1.0) AS o"
_HOUR = "CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS INTEGER)"
SQL = {
    "tracks_dense": f"tracks_dense AS (SELECT user_id AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS f, {_VALUES} FROM events)",
    "tracks_gappy": f"tracks_gappy AS (SELECT user_id AS t, {_HOUR} AS f, {_VALUES} FROM events)",
    "dots": f"dots AS (SELECT {_HOUR} // 24 AS f, {_VALUES} FROM events)",
    "points": "points AS (SELECT label AS f, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, atan2(CAST(embedding[4] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS o FROM embeddings)",
    "dup_lines": "dup_lines AS (SELECT l_orderkey AS t, l_linenumber AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)",
    "orders_series": "orders_series AS (SELECT o_custkey AS t, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS f, o_orderkey AS id, ln(o_totalprice) AS x FROM orders)",
}
