"""Linking of dots on a stream: each dot's parent by the rule of `operators.linking.parents`, as soon as its frame is behind the watermark.

The stream of dots meets itself over an interval of `giveup` frames and cells of the largest reach, so what is kept of it is that many frames and the watermark's delay. Two grouped minima over the pairs,
each dot's best parent and each parent's nearest dot of a frame, end with their frame; a last join over equal frames keeps a parent unless another dot of the frame is nearer to it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _interval(millis: int) -> str:
    return f"interval {millis} milliseconds"


def stream_parents(dots: DataFrame, reach: float = 20.0, giveup: int = 10, frame_millis: int = 1_000, delay_frames: int = 2) -> DataFrame:
    """(ts, id, parent) of the dots that have one, from a stream (ts, id, x, y), a frame every frame_millis; dots without a parent are those of the stream that have no row.

    ts is its frame's time; dots may come up to delay_frames late. In append mode a dot's row comes once the watermark, which the latest dot less the delay sets, is behind its frame.
    """
    size = reach * math.sqrt(giveup)
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    delay, frame = _interval(delay_frames * frame_millis), _interval(frame_millis)

    def near() -> DataFrame:
        seen = dots.withWatermark("ts", delay)
        child = seen.select("ts", "id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
        old = seen.select(F.col("ts").alias("old"), F.col("id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(around).alias("k"))
        old = old.select("old", "p", "px", "py", (cell("px") + F.col("k.i")).alias("ox"), (cell("py") + F.col("k.j")).alias("oy"))
        span = f"ts >= old + {frame} AND ts <= old + {_interval(giveup * frame_millis)}"
        met = child.join(old, (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy")) & F.expr(span))
        met = met.withColumns({"n": F.round((F.unix_millis("ts") - F.unix_millis("old")) / frame_millis).cast("int"), "d": F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))})
        return met.where(F.col("d") < reach * F.sqrt(F.col("n").cast("double")))

    best = near().groupBy(F.window("ts", frame), "id").agg(F.min(F.struct("n", "d", "p")).alias("b")).select("window", "id", "b.*")
    rival = near().groupBy(F.window("ts", frame).alias("w"), F.col("p").alias("rp"), F.col("n").alias("rn")).agg(F.min("d").alias("least"))
    settled = best.join(rival, (F.col("window") == F.col("w")) & (F.col("p") == F.col("rp")) & (F.col("n") == F.col("rn"))).where("d <= least")
    return settled.select(F.col("window.start").alias("ts"), "id", F.col("p").alias("parent"))
