"""Statistics of every slice of frames of a grid, from one pass over the data, and prefix trees of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfield.operators.scans import LARGE, Scan


def slice_grid(df: DataFrame, values: Sequence[str], starts: Sequence[int], stops: Sequence[int], by: str, f: str = "f", large: int | None = LARGE) -> DataFrame:
    """(by, start, stop, rows, and for each value v: n_v, mean_v, var_v, skew_v): moments over the frames from start up to, not including, stop, for all starts and stops given.

    Frames count from each group's first; a stop of 0 or less counts back from behind its last. The moments' sums by frame are summed up along the frames, so every slice is the difference of
    two rows, however many there are. Values are taken from their group's first known value, which keeps the sums small. Empty slices are left out; moments are NULL without known values, the
    variance is that of a sample.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(f).isNotNull())
    origin = rows.groupBy(by).agg(F.min(f).alias("__lo"), F.max(f).alias("__hi"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(f))).cast("double").alias(f"__o{k}") for k, c in enumerate(values)])
    at = rows.join(origin, by).select(by, (F.col(f) - F.col("__lo")).alias("__at"), (F.col("__hi") - F.col("__lo") + 1).alias("__len"), *[(F.col(c) - F.col(f"__o{k}")).alias(f"__v{k}") for k, c in enumerate(values)])
    power = lambda k, p: F.pow(f"__v{k}", F.lit(float(p)))
    sums = {"rows": F.count(F.lit(1)).cast("double")} | {f"s{k}_{p}": F.coalesce(F.sum(power(k, p)), F.lit(0.0)) for k in range(len(values)) for p in range(1, 4)} | {f"s{k}_0": F.count(f"__v{k}").cast("double") for k in range(len(values))}
    frames = at.groupBy(by, "__at", "__len").agg(*[c.alias(n) for n, c in sums.items()])
    scan = Scan(frames, by, "__at", large).add(__next=("lead", F.col("__at")), **{f"__p_{n}": ("sum", F.col(n)) for n in sums})
    # a border between a frame and the next has the sums up to that frame
    borders = F.array_distinct(F.array(*[F.lit(int(s)) for s in starts], *[F.lit(int(s)) if s > 0 else F.col("__len") + int(s) for s in stops]))
    mine = F.filter(borders, lambda b: (b > F.col("__at")) & (F.col("__next").isNull() | (b <= F.col("__next.v"))))
    known = scan.df.select(by, F.explode(mine).alias("__b"), *[F.col(f"__p_{n}").alias(n) for n in sums])
    pair = [F.struct(F.lit(int(a)).alias("start"), F.lit(int(b)).alias("stop")) for a in starts for b in stops]
    grid = origin.select(by, *[f"__o{k}" for k in range(len(values))], (F.col("__hi") - F.col("__lo") + 1).alias("__len"), F.explode(F.array(*pair)).alias("s")).select("*", "s.*").drop("s")
    grid = grid.withColumn("__stop", F.when(F.col("stop") > 0, F.col("stop")).otherwise(F.col("__len") + F.col("stop"))).where("__stop > start")
    side = lambda n: known.select(by, F.col("__b").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in sums])
    met = grid.join(side("start"), [by, "start"], "left").join(side("__stop"), [by, "__stop"], "left")
    met = met.select(by, "start", "stop", *[f"__o{k}" for k in range(len(values))], *[(F.coalesce(f"__stop_{c}", F.lit(0.0)) - F.coalesce(f"start_{c}", F.lit(0.0))).alias(c) for c in sums]).where("rows > 0")
    out = [F.col("rows").cast("long").alias("rows")]
    for k, c in enumerate(values):
        n, a, b, d = (F.col(f"s{k}_{p}") for p in range(4))
        mean = F.try_divide(a, n)
        m2, m3 = F.greatest(F.try_divide(b, n) - mean * mean, F.lit(0.0)), F.try_divide(d, n) - 3 * mean * F.try_divide(b, n) + 2 * F.pow(mean, 3)
        out += [n.cast("long").alias(f"n_{c}"), (mean + F.col(f"__o{k}")).alias(f"mean_{c}"), F.when(n > 1, m2 * n / (n - 1)).alias(f"var_{c}"), F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))).alias(f"skew_{c}")]
    return met.select(by, "start", "stop", *out)


def prefix_tree(names: DataFrame, name: str) -> DataFrame:
    """(prefix, parent, name): the tree of distinct names in which a node is a prefix that goes on in more than one way.

    Leaves have their name, and as prefix the shortest that no other name has; nodes have NULL there. The root is '' and has no row. Prefixes are grouped level by level in one aggregation; the work grows with the names' characters.
    """
    rows = names.select(F.col(name).cast("string").alias("name")).where("name is not null").distinct()
    size = F.length("name")
    cut = rows.where(size > 0).select("name", F.explode(F.sequence(F.lit(1), size)).alias("k")).select("name", "k", F.expr("substr(name, 1, k)").alias("prefix"), F.expr("substr(name, k + 1, 1)").alias("on"))
    nodes = cut.groupBy("prefix").agg(F.count_distinct("on").alias("ways")).where("ways > 1").select("prefix", F.length("prefix").alias("k"))
    # of the nodes on a name's way the last one is its parent; a node's own way ends before it
    above = cut.join(nodes.select("prefix"), "prefix")
    leaves = rows.join(above.groupBy("name").agg(F.max("k").alias("k")), "name", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    leaves = leaves.select(F.expr("substr(name, 1, k + 1)").alias("prefix"), F.expr("substr(name, 1, k)").alias("parent"), "name")
    shorter = nodes.where("k > 1").select(F.col("prefix").alias("node"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i")).select("node", "i", F.expr("substr(node, 1, i)").alias("prefix"))
    up = shorter.join(nodes.select("prefix"), "prefix").groupBy(F.col("node").alias("prefix")).agg(F.max("i").alias("i"))
    inner = nodes.join(up, "prefix", "left").select("prefix", F.expr("substr(prefix, 1, coalesce(i, 0))").alias("parent"), F.lit(None).cast("string").alias("name"))
    return leaves.unionByName(inner)
