"""Merkle manifest of a dataset: a hash tree over every group's rows, one over the groups, and a proof for every row.

Build, from the bottom up: leaves are numbered within their group, and every persisted level joins the digests of up to 2^stride
neighbouring nodes into the row of their common ancestor, stride binary levels higher; that ancestor's digest is a node of the next
persisted level. The groups' subroots are the leaves of a last tree of the same kind, whose root stands for the dataset.

Proofs, from the top down: the root's proof is empty. A persisted level joins its rows with the proofs of their ancestors, and each child
puts its own siblings before the suffix it inherits. So a proof is never put together by one task from all levels, and only the lowest level meets
it once for every leaf.

A digest is the lowercase hex text of a sha256; a leaf's is taken over its fields, each as the number of its UTF-8 bytes, a colon and the value, or `-`
for a NULL. Nodes meet in pairs; the last one of a level, if alone, is hashed alone.

Defined results: any field may be NULL or empty; a NULL group is a group, before all others. Leaves of a group are ordered by their id, NULLs first,
then by their digest, so that rows which repeat an id have places that don't depend on how the table is dealt; rows equal in all fields have proofs of
their own. An empty table has no leaves, no root and an empty result. Texts are hashed where they are read and never shuffled. The caller's columns are read by name; the
result has none of them but the id.

At scale: leaves are numbered by ranges, so a group with most of the rows is dealt over all tasks; what is summed up along the ranges is a row for each range and group. A level's row
holds at most 2^stride nodes. Every level is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import partitions, read, sized, staged

#: Binary levels of a persisted level.
STRIDE = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def framed(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and its text; `-` for a NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with pos, their number from 0 within their group, and (group, n). order ends in a column that no two rows share."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    # the id holds the range's number above its lower 33 bits and the row's place below
    placed = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed").withColumn("__range", F.shiftright("__at", 33))
    parts = placed.groupBy(group, "__range").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0))), "parts")
    on = placed[group].eqNullSafe(parts[group]) & (placed["__range"] == parts["__range"])
    pos = F.col("__at") - F.col("__from") + F.col("__before")
    numbered = placed.join(sized(parts, parts.count()), on).select(placed["*"], pos.alias("pos")).drop("__at", "__range")
    return numbered, parts.groupBy(group).agg(F.sum("__n").alias("n"))


def _depth(n: Column) -> Column:
    """Levels above n leaves: the least k with 2^k >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _above(nodes: Column) -> Column:
    """The digests a level higher."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes and the digests of so many levels above them, as an array for each level."""
    return F.aggregate(F.slice(F.sequence(F.lit(0), steps), 2, STRIDE_MOST), F.array(nodes), lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))))


#: More than any stride: arrays that begin with a dummy are cut behind it.
STRIDE_MOST = 64


class HashForest:
    """A hash tree for each tree id, over leaves (tree, pos, digest, other columns), built level by level.

    leaves: columns tree, pos, digest and more, which come back beside the proofs. sizes: (tree, n), the number of each tree's leaves.
    """

    def __init__(self, leaves: DataFrame, sizes: DataFrame, stride: int = STRIDE):
        if not 1 <= stride < 16:
            raise ValueError("a stride of 1 to 15")
        self.stride, self.more = stride, [c for c in leaves.columns if c not in ("tree", "pos", "digest")]
        sizes = sizes.select("tree", _depth(F.col("n")).alias("depth"))
        self.depth = sizes.agg(F.max("depth").alias("d")).first()["d"]
        self.tables: list[DataFrame] = []
        if self.depth is None:
            self.roots = leaves.select("tree", F.col("digest").alias("root")).limit(0)
            return
        nodes = leaves.join(sized(sizes, sizes.count()), leaves["tree"].eqNullSafe(sizes["tree"])).select(leaves["*"], "depth")
        done = None
        for low in range(0, max(self.depth, 1), stride):
            members = F.sort_array(F.collect_list(F.struct("pos", "digest", *(self.more if low == 0 else []))))
            rows = nodes.groupBy("tree", F.shiftright("pos", stride).alias("block"), "depth").agg(members.alias("members"))
            levels = _levels(F.col("members.digest"), F.least(F.lit(stride), F.col("depth") - low))
            table = staged(rows.withColumn("levels", levels), "level")
            self.tables.append(table)
            top = table.select("tree", F.col("block").alias("pos"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "depth")
            ended = top.where(F.col("depth") <= low + stride).select("tree", F.col("digest").alias("root"))
            done = ended if done is None else done.unionByName(ended)
            nodes = top.where(F.col("depth") > low + stride)
        self.roots = done

    def proofs(self, given: DataFrame) -> DataFrame:
        """Every leaf with its proof, down from given: (tree, proof, other columns), what each tree's root inherits.

        A proof is an array of (left, sibling): whether the sibling stands before the node, and its digest, NULL for a node alone.
        """
        more, pushed = [c for c in given.columns if c not in ("tree", "proof")], None
        for k in reversed(range(len(self.tables))):
            # a tree that ends here has one row, which gets what is given; the others' rows inherit from the level above
            table = self.tables[k]
            ends = table.where(F.col("depth") <= (k + 1) * self.stride).select("tree")
            inherited = given.join(ends, "tree").select("tree", F.lit(0).cast("long").alias("block"), F.col("proof").alias("suffix"), *more)
            if pushed is not None:
                inherited = inherited.unionByName(pushed.select("tree", F.col("pos").alias("block"), "suffix", *more))
            met = table.join(inherited, ["tree", "block"])
            child = met.select("tree", "block", "suffix", "levels", *more, F.explode("members").alias("m")).select("tree", "block", "suffix", "levels", *more, "m.*")
            at = (F.col("pos") - F.shiftleft("block", self.stride)).cast("int")
            own = F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda nodes, i: _sibling(nodes, at, i))  # noqa: B023
            pushed = child.select("tree", "pos", "digest", *(self.more if k == 0 else []), F.concat(own, "suffix").alias("suffix"), *more)
            if k:
                pushed = staged(pushed, "proofs")
        return pushed.withColumnRenamed("suffix", "proof")


def _sibling(nodes: Column, at: Column, level: Column) -> Column:
    i = F.call_function("shiftright", at, level)
    left = i % 2 == 1
    return F.struct(left.alias("left"), F.get(nodes, F.when(left, i - 1).otherwise(i + 1).cast("int")).alias("sibling"))


def proof_digest(proof: Column) -> Column:
    """sha256 over the siblings of a proof, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.when(s["left"], F.concat(s["sibling"], node)).otherwise(F.concat(node, F.coalesce(s["sibling"], F.lit("")))), 256))


_PROOF = "array<struct<left:boolean,sibling:string>>"


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: list[str] | None = None, given: DataFrame | None = None, stride: int = STRIDE) -> DataFrame:
    """(key, leaf, given, subroot, root, proof) for each row.

    fields: what a leaf is the digest of, in this order. given: a second digest of each row, kept beside the first, as a Column.
    """
    parts = [framed(F.col(c)) for c in fields or FIELDS]
    given = F.lit(None).cast("string") if given is None else given
    # the row number tells apart rows that are equal in all else
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), digest(*parts).alias("digest"), given.alias("given"), F.monotonically_increasing_id().alias("row"))
    numbered, sizes = _numbered(staged(leaves, "leaves"), "group", ["key", "digest", "row"])
    # groups get numbers, in their order, which stand for them from here on
    groups, count = _numbered(sizes.withColumn("one", F.lit(0)), "one", ["group"])
    groups = staged(groups.select("group", "n", F.col("pos").alias("tree")), "groups")
    small = sized(groups.select("group", "tree"), groups.count())
    leaves = numbered.join(small, numbered["group"].eqNullSafe(small["group"])).select("tree", "pos", "digest", "key", "given")
    forest = HashForest(leaves, groups.select("tree", "n"), stride)
    tops = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"))
    upper = HashForest(tops, count.select(F.lit(0).cast("long").alias("tree"), "n"), stride)
    if upper.depth is None:
        return numbered.select("key", F.col("digest").alias("leaf"), "given", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.lit(None).cast(_PROOF).alias("proof")).limit(0)
    start = upper.roots.select("tree", F.array().cast(_PROOF).alias("proof"), "root")
    subroots = staged(upper.proofs(start).select(F.col("pos").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "subroots")
    return forest.proofs(subroots).select("key", F.col("digest").alias("leaf"), "given", "subroot", "root", "proof")


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    """Query: the manifest of the documents and its verification with some rows tampered with."""
    docs = read(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = {c: framed(F.col(c)) for c in FIELDS} | {"n_chars": framed(F.col("n_chars").cast("decimal(20,0)") + 1)}
    found = manifest(docs, given=F.when(touched, digest(*changed.values())))
    root = folded(F.coalesce("given", "leaf"), F.col("proof"))
    out = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
