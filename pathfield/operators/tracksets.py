"""Track sets in one call: frame and row slices, length, duplicates, unwrapped angles, gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfield.operators import groups, linking, sequence
from pathfield.operators.scans import Scan


def parse_slice(text: str | slice | None) -> slice:
    """start:stop:step as text, parts may be left out; a single number is a stop."""
    if text is None:
        return slice(None)
    if isinstance(text, slice):
        return text
    parts = [int(p) if p.strip() else None for p in text.split(":")]
    if len(parts) > 3:
        raise ValueError(f"not a slice: {text}")
    return slice(*parts)


def _position(i: str, n: str, at: int | None, default: str):
    """A slice's bound as a row position: negative ones count from the end."""
    if at is None:
        return F.col(n) if default == "n" else F.lit(0)
    return F.greatest(F.col(n) + at, F.lit(0)) if at < 0 else F.lit(at)


def sliced(df: DataFrame, rows: str | slice | None, by: str = "t", order: str = "f") -> DataFrame:
    """The rows of each group that a slice of its rows in order takes; step -1 reverses, counting the order back from the group's last.

    Other negative steps are refused.
    """
    s = parse_slice(rows)
    step = s.step or 1
    if step < -1:
        raise ValueError("a step of -1 or more")
    if step == -1:
        df = Scan(df, by, order).add(__top=("top", F.col(order))).with_columns(**{order: F.col("__top") - F.col(order)}).done()
        step = 1
    at = Scan(df, by, order).add(__r=("sum", F.lit(1)), __n=("total", F.lit(1))).with_columns(__i=F.col("__r") - 1).done("__i", "__n")
    low, high = _position("__i", "__n", s.start, "0"), _position("__i", "__n", s.stop, "n")
    return at.where((F.col("__i") >= low) & (F.col("__i") < high) & ((F.col("__i") - low) % step == 0)).drop("__i", "__n")


def frame_slice(df: DataFrame, frames: str | slice | None, f: str = "f") -> DataFrame:
    """Rows of the frames that a slice of the list of all frames takes.

    The list is a table of the distinct frames, numbered in staged ranges, not by a window over all of it.
    """
    s = parse_slice(frames)
    if s == slice(None):
        return df
    if (s.step or 1) < 1:
        raise ValueError("a step above 0")
    listed = linking.dense_rank(df.select(f).where(F.col(f).isNotNull()).distinct(), f).withColumnRenamed("rank", "__i")
    listed = listed.join(F.broadcast(listed.agg(F.count(F.lit(1)).alias("__n"))))
    low, high = _position("__i", "__n", s.start, "0"), _position("__i", "__n", s.stop, "n")
    kept = listed.where((F.col("__i") >= low) & (F.col("__i") < high) & ((F.col("__i") - low) % (s.step or 1) == 0)).select(f)
    return df.join(kept, f, "left_semi")


def tracksets(
    tracks: DataFrame, least: int = 10, rows: str | None = None, frames: str | None = None, dedupe: bool = False, gaps: str = "leave", unwrap: bool = False, most: int = 10
) -> DataFrame:
    """Rows of the tracks with at least `least` rows (negative: of so many longest), cleaned.

    In this order: slice of the frames; length; the step of the slice of rows; duplicates; unwrapped angles; gaps ('leave', 'nans' adds rows of
    NULLs, 'interp' also fills runs of up to `most` by lines); start and stop of the slice of rows. Angles unwrapped for the lines alone are
    wrapped again to [0, 2 pi).
    """
    if gaps not in ("leave", "nans", "interp"):
        raise ValueError(f"unknown gaps: {gaps}")
    s = parse_slice(rows)
    out = groups.length_filter(frame_slice(tracks, frames), least) if least else frame_slice(tracks, frames).where("t >= 0")
    if s.step:
        out = sliced(out, slice(None, None, s.step))
    if dedupe:
        out = sequence.dedupe(out)
    if unwrap or gaps == "interp":
        out = sequence.unwrap(out)
    if gaps != "leave":
        out = sequence.densify(out).drop("is_filled")
    if gaps == "interp":
        out = sequence.interpolate(out, ["x", "y", "o"], most)
        if not unwrap:
            out = out.withColumn("o", F.pmod("o", F.lit(2 * math.pi)))
    return sliced(out, slice(s.start, s.stop)) if s.start is not None or s.stop is not None else out
