"""Connected components of a graph given as a table of links, and roots of a forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pathfield.checkpoints import staged


def staged_and_seen(df: DataFrame, label: str, *what: Column) -> tuple[DataFrame, dict]:
    """df as a staged table, with aggregates that the write itself takes."""
    seen = Observation()
    return staged(df.observe(seen, *what), label), seen.get


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """links (a, b) to (id, component): every id that is in a link, with the smallest id it reaches.

    Alternates two steps until nothing changes: every id hands its larger neighbours, then its smaller ones, to the smallest
    of its neighbourhood. Each step is a grouped minimum, which hubs enter as partial results, and a join; each
    result is a table in the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    edges = staged(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, now = staged_and_seen(after, label, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        if now == before:
            break
        before = now
    # nothing changes any more: every edge leads to the smallest id of its component
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def roots(pointers: DataFrame) -> DataFrame:
    """(id, parent) to (id, root), a root being its own: the pointers of those that are parents are doubled twice a round until none moves; each round is a staged table. The others take their parent's root."""
    every = staged(pointers.where("id is not null").select("id", "parent"), "pointers")
    inner = every.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    state = staged(inner.join(every, "id").select("id", F.coalesce("parent", "id").alias("root")), "roots")
    while True:
        up = lambda s: s.select(F.col("id").alias("root"), F.col("root").alias("next"))
        once = state.join(up(state), "root").select("id", F.col("next").alias("root"))
        twice = once.join(up(state), "root").select("id", F.col("root").alias("before"), F.col("next").alias("root"))
        state, seen = staged_and_seen(twice, "roots", F.count_if(F.col("before") != F.col("root")).alias("moved"))
        state = state.select("id", "root")
        if not seen["moved"]:
            break
    tops = every.where("parent is null").select("id", F.col("id").alias("root"))
    return tops.unionByName(every.join(state.select(F.col("id").alias("parent"), "root"), "parent").select("id", "root"))
