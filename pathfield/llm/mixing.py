"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

Each source gets a target share of the output. A document of source s is repeated Poisson(rate) times, with
rate = share * rows wanted / documents of s. The rate is cut into equal parts of at most PART, whose draws add up: for each part a
uniform number hashed from (doc_id, text digest, seed, part) is put through the inverse of the distribution's cumulative sums,
which are made once a source and stay short whatever the rate. The copies are exploded and shuffled globally by another hash.

Defined results: documents without a source form a source of their own; without given shares every source weighs
the same; rows that repeat in every hashed column draw the same count; a null doc_id or text hashes as an empty string; an empty table
stays empty; a text's length doesn't matter. All columns of the caller are kept, whatever their names: where one is called copy or
shuffle_key, the added column's name gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfield.llm.common import read, sized

SEED = "mix-1"
#: Largest mean of one draw, copies exploded at once.
PART, BLOCK = 16, 4_096
#: Sources whose sums, at most about 100 numbers each, are broadcast.
SOURCES = 20_000


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a text, the same in every engine that has MD5: its first 13 hex digits."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below double precision, for rates up to PART."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), zero, step)["all"]).otherwise(F.array(F.lit(1.0)))


def drawn(key: Column, parts: Column, sums: Column) -> Column:
    """Sum of the parts' draws: of each part, how many of the cumulative sums its uniform number reaches."""

    def draw(part: Column) -> Column:
        u = uniform(F.when(part == 0, key).otherwise(F.concat_ws("|", key, part.cast("string"))))
        return F.size(F.filter(sums, lambda c: c <= u)).cast("long")

    return F.aggregate(F.sequence(F.lit(0).cast("long"), parts - 1), F.lit(0).cast("long"), lambda acc, part: acc + draw(part))


def source_rates(docs: DataFrame, shares: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(source, rate): mean repetitions of a document of each source.

    shares: (source, share), any positive scale, a source at most once; sources without a row get none.
    rows: size of the mix; by default that of docs.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if shares is not None:
        shares = shares.select(F.col("source").alias("__source"), F.col("share").cast("double").alias("share"))
        counts = counts.join(shares, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").fillna(0.0, ["share"])
    else:
        counts = counts.withColumn("share", F.lit(1.0))
    totals = counts.agg(F.sum("n").alias("all"), F.sum("share").alias("shares")).first()
    wanted = float(totals["all"] or 0 if rows is None else rows)
    rate = F.col("share") * F.lit(wanted / totals["shares"] if totals["shares"] else 0.0) / F.col("n")
    return counts.select("source", rate.alias("rate"))


def poisson_mix(docs: DataFrame, shares: DataFrame | None = None, rows: int | None = None, seed: str = SEED) -> DataFrame:
    """The columns of docs and copy (from 1), shuffle_key: each document once for every copy, in an order dealt by shuffle_key."""
    names = docs.columns
    copy, order = added(names, "copy"), added(names, "shuffle_key")
    key, of, parts, sums, n, block = (added(names, f"__{x}") for x in ("key", "of", "parts", "sums", "n", "block"))
    rates = source_rates(docs, shares, rows)
    pieces = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("long")
    table = rates.select("source", "rate", pieces.alias("pieces")).select(F.col("source").alias(of), F.col("pieces").alias(parts), cumulative(F.col("rate") / F.col("pieces")).alias(sums))
    table = sized(table, rates.count(), SOURCES)
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))), F.lit(seed))
    counted = docs.withColumn(key, text).join(table, F.col("source").eqNullSafe(F.col(of)), "left").withColumn(n, drawn(F.col(key), F.col(parts), F.col(sums))).where(F.col(n) > 0)
    # a document's copies are exploded in blocks, so that no array grows with the rate
    blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK))))
    last = F.least(F.col(n), (F.col(block) + 1) * BLOCK)
    copies = blocks.withColumn(copy, F.explode(F.sequence(F.col(block) * BLOCK + 1, last))).withColumn(copy, F.col(copy).cast("int"))
    mixed = copies.withColumn(order, F.md5(F.concat_ws("|", F.col(key), F.col(copy).cast("string"), F.lit("order"))))
    return mixed.select(*[F.col(f"`{c}`") for c in (*names, copy, order)]).repartition(F.col(order)).sortWithinPartitions(order)


def added(names: list[str], name: str) -> str:
    """A name for a new column: the given one, with underscores if the caller has it."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents mixed to equal weights of their sources."""
    return poisson_mix(read(spark, sf_dir, "documents"))
