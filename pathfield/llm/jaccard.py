"""N-gram Jaccard join by signature trees.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least 0.8. Equal sets become
one class first. A class is indexed under the first tokens of its set, in an order that puts widespread shingles last:
any two linked classes share one of these (prefix filtering), so all work happens within the tokens' groups.

The nodes of a group's signature tree hold the OR of their members' token bitmaps and the range of their set sizes. Its lowest nodes are
clusters of verified links, grown around centres in a pass over the texts; further passes merge the clusters of groups that
hold several. The tree of every group that still holds several is then traversed against itself: a pair of nodes is dropped when sizes, or the bits the two bitmaps
share, leave no room for the overlap a link needs; pairs left at the leaves of enough trees are verified on the whole sets.
Components come from the verified links.

Every link between different sets is verified, or lies within a component that verified links have already joined. Groups of
any size are dealt out in blocks, nothing is dropped. Defined results: a null or empty text has no shingle, links with nothing and
is its own component; a document without an id has no component; rows that share a doc_id count as one document with several
texts, each row returned once. A very long text is hashed in chunks, its bitmap stays within MOST_BITS; an empty table has an empty result; columns
of the caller may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import bucketed, partitions, read, staged
from pathfield.llm.shingles import overlap, set_digest, shingle_sets
from pathfield.operators.graph import components

#: Bits of the smallest and of the largest bitmap.
LEAST_BITS, MOST_BITS = 128, 8_192
#: Part of the documents whose shingles show what is widespread, and how many of them must have a shingle to be of level 1, 2, 3. A part,
#: not a number: what counts as widespread must not move with the size of the input, or the groups of other tokens would grow with it.
SAMPLE, WIDESPREAD = 0.25, (4, 16, 64)
#: Slots of the table of levels: 4 MB whatever the input. Where shingles crowd the slots, the higher levels fill up last.
SLOTS = 1 << 24
#: Slots in a word of the table, two bits each.
PER_WORD = 32
#: Centres a cluster pass keeps for a group, members of a group in one task, members of a tree block.
CENTRES, GROUP, BLOCK = 24, 2_048, 16_384
#: Passes that merge clusters before the trees: without them a large group of near copies in several clusters leaves all its pairs.
MERGES = 2
#: Members of a leaf, nodes below a node.
LEAF, FAN = 16, 8
#: Pairs a task holds before it hands them on, tasks that crowded groups of one first id are dealt over.
HELD, SPREAD = 1 << 18, 4


def linked(common: int, a: int, b: int) -> bool:
    """Whether sets of these sizes with so many shingles in common link."""
    return 100 * common >= 80 * (a + b - common) and common > 0


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit set for every shingle, of a power of two of bits: at least 2 for each of up to 1,024 shingles and 1 for each of more, within bounds.

    A bitmap repeated to twice its size has every bit that the set's bitmap of that size has.
    """
    n = len(shingles)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << ((2 * n if n <= 1024 else n) - 1).bit_length() if n else 1))
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _texts(batch: pa.RecordBatch, at: int, size: int = 256) -> list[str | None]:
    return batch.column("text").slice(at, size).to_pylist()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, bits = [], [], []
        for at in range(0, batch.num_rows, 256):
            for s in shingle_sets(_texts(batch, at)):
                n.append(len(s))
                digests.append(set_digest(s))
                bits.append(bitmap(s).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "digest", "bits"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            found = shingle_sets(_texts(batch, at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _levels(docs: DataFrame) -> np.ndarray:
    """How widespread the shingles of each slot are, from 0 to 3, in a part of the documents. Only the order of tokens depends on it, no link.

    The driver takes the slots as words of 64 bits, at most SLOTS / PER_WORD rows.
    """
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.where(chance < SAMPLE).select("text")
    counts = sample.mapInArrow(_flat, "shingle long").groupBy("shingle").count().where(F.col("count") >= WIDESPREAD[0])
    level = sum((F.col("count") >= least).cast("long") for least in WIDESPREAD)
    slots = counts.groupBy(F.shiftrightunsigned("shingle", 64 - SLOTS.bit_length() + 1).alias("slot")).agg(F.max(level).alias("level"))
    bits = F.expr(f"shiftleft(level, cast(2 * (slot % {PER_WORD}) as int))")
    words = slots.groupBy(F.expr(f"slot div {PER_WORD}").alias("word")).agg(F.bit_or(bits).alias("bits")).toPandas()
    table = np.zeros(SLOTS // PER_WORD, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def ordered(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tokens of shingles: numbers in the order of levels, then of hashes."""
    slots = _slots(shingles)
    level = table[slots // PER_WORD] >> (2 * (slots % PER_WORD)).astype(np.uint64) & np.uint64(3)
    return shingles >> np.uint64(2) | level << np.uint64(62)


def _postings(held):
    """(token, n, at, id) of the tokens a set is indexed under: enough of its first ones that linked sets share one. at: place in the set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 256):
                tokens, sizes, taken = [], [], []
                for s in shingle_sets(_texts(batch, at)):
                    n = len(s)
                    keep = n - (4 * n + 4) // 5 + 1 if n else 0
                    order = ordered(s, held.value)
                    tokens.append(np.sort(order if keep < 64 else np.partition(order, keep - 1)[:keep])[:keep])
                    sizes.append(n)
                    taken.append(keep)
                places = np.concatenate([np.arange(k) for k in taken])
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(sizes, taken), places, np.repeat(ids[at : at + 256], taken)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["token", "n", "at", "id"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings to those of tokens that several ids have, each with the centre it is tried with first.

    A centre is the first of its token's ids that no earlier centre's size reaches.
    """
    names = ("token", "n", "at", "id")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    rest = [np.zeros(0, np.int64)] * len(names)
    before = current = centre = None
    centre_n = 0

    def block(columns: list[np.ndarray], last: bool) -> pa.RecordBatch:
        nonlocal before, current, centre, centre_n
        token = columns[0]
        stop = len(token) if last else len(token) - 1
        same = np.zeros(len(token) + 1, bool)
        if len(token):
            same[0] = before is not None and token[0] == before
            same[1:-1] = token[1:] == token[:-1]
        keep = np.flatnonzero((same[:-1] | same[1:])[:stop])
        if stop:
            before = token[stop - 1]
        found = [c[keep] for c in columns]
        centres = []
        for t, n, i in zip(*(found[k].tolist() for k in (0, 1, 3)), strict=True):
            if t != current or 5 * centre_n < 4 * n:
                current, centre, centre_n = t, i, n
            centres.append(centre)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*found, np.array(centres, np.int64)), kinds, strict=True)], [*names, "centre"])

    for batch in batches:
        if batch.num_rows:
            columns = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, names, strict=True)]
            yield block(columns, False)
            rest = [c[-1:] for c in columns]
    yield block(rest, True)


def _verify(grow: bool):
    """Rows of a group: its centre's texts first, then its members'. Links of members with the centre, or any of several centres.

    grow: a member that links with no centre becomes one, up to CENTRES; a member isn't compared with centres it has been joined to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        centres: list[tuple[int, np.ndarray, list[int]]] = []
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            keys = [batch.column(c).to_pylist() for c in ("centre", "salt", "id")]
            for at in range(0, batch.num_rows, 256):
                for centre, salt, i, s in zip(*(k[at : at + 256] for k in keys), shingle_sets(_texts(batch, at)), strict=True):
                    if (centre, salt) != group:
                        group, centres = (centre, salt), []
                    if i == centre:
                        centres.append((i, s, [0]))
                        continue
                    joined: list[int] | None = None
                    for c, t, place in centres:
                        if joined is not None and place[0] == joined[0] or 5 * min(len(s), len(t)) < 4 * max(len(s), len(t)):
                            continue
                        if linked(overlap(s, t), len(s), len(t)):
                            a.append(c)
                            b.append(i)
                            if joined is None:
                                joined = place
                            else:
                                old = place[0]
                                for _, _, p in centres:
                                    if p[0] == old:
                                        p[0] = joined[0]
                    if grow and joined is None and len(centres) < CENTRES:
                        centres.append((i, s, [len(centres)]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _check(pairs: DataFrame, texts: DataFrame, grow: bool, label: str) -> DataFrame:
    """Links (a, b) among the pairs (centre, id), on whole sets. Large groups are dealt over several tasks, each with the centre."""
    parts = pairs.groupBy("centre").count().select("centre", F.expr(f"cast((count - 1) div {GROUP} + 1 as int)").alias("parts"))
    members = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), "id")
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("centre").alias("id"))
    rows = members.unionByName(centres).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    dealt = rows.select("centre", "salt", (F.col("id") != F.col("centre")).alias("member"), "id", "text").repartition("centre", "salt")
    dealt = dealt.sortWithinPartitions("centre", "salt", "member", "id")
    return staged(dealt.select("centre", "salt", "id", "text").mapInArrow(_verify(grow), "a long, b long"), label)


def _possible(low, high, slack, bits, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of node pairs, those whose sizes and shared bits leave room for a link.

    No set of node i shares more with one of node j than the bits both bitmaps have plus the shingles that share a bit (slack).
    """
    common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
    most = np.minimum(np.minimum(high[i], high[j]), common + np.minimum(slack[i], slack[j]))
    return (9 * most >= 4 * (low[i] + low[j])) & (5 * high[i] >= 4 * low[j]) & (5 * high[j] >= 4 * low[i])


class SignatureTree:
    """Tree over sets in the order of their sizes. Level 0 are the sets themselves, each level's nodes cover a stretch of the one below."""

    def __init__(self, n: np.ndarray, slack: np.ndarray, component: np.ndarray, bits: np.ndarray):
        self.levels = [(n, n, slack, bits, component, component)]
        self.fans = []
        while len(self.levels[-1][0]) > 1:
            fan = FAN if self.fans else LEAF
            low, high, slack, bits, least, most = self.levels[-1]
            cut = np.arange(0, len(low), fan)
            self.levels.append((low[cut], np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))
            self.fans.append(fan)

    def survivors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets, of different components, that no bound excludes; the tree is traversed against itself."""
        root = np.zeros(1, np.int64)
        stack = [(len(self.fans), root, root)]
        while stack:
            level, i, j = stack.pop()
            low, high, slack, bits, least, most = self.levels[level]
            keep = _possible(low, high, slack, bits, i, j)
            keep &= ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j]))
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            fan, n = self.fans[level - 1], len(self.levels[level - 1][0])
            x, y = (k.ravel() for k in np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"))
            for at in range(0, len(i), 4096):
                ci, cj = (i[at : at + 4096, None] * fan + x).ravel(), (j[at : at + 4096, None] * fan + y).ravel()
                ok = (ci < n) & (cj < n) & ((ci < cj) if level == 1 else (ci <= cj))
                stack.append((level - 1, ci[ok], cj[ok]))


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the tokens they are indexed under two linked sets of these sizes share at least; see _frequent."""
    return (4 * (a + b) + 8) // 9 + 1 - (4 * np.maximum(a, b) + 4) // 5


def _leaf_pairs(cuts: np.ndarray, n: np.ndarray, slack: np.ndarray, component: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of all trees that are one leaf, at once. cuts: where the trees begin and end."""
    sizes = np.diff(cuts)
    tree = np.repeat(np.where(sizes <= LEAF, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for d in range(1, min(LEAF, len(n))):
        i = np.flatnonzero((tree[:-d] == tree[d:]) & (tree[d:] >= 0) & (component[:-d] != component[d:]) & (5 * n[:-d] >= 4 * n[d:]))
        for at in range(0, len(i), 65_536):
            x = i[at : at + 65_536]
            x = x[_possible(n, n, slack, bits, x, x + d)]
            yield x, x + d


def _same_width(bits: list[bytes], words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps as rows of `width` words, smaller ones repeated."""
    out = np.empty((len(bits), width), np.uint64)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[at] = np.tile(np.frombuffer(b"".join([bits[k] for k in at.tolist()]), np.uint64).reshape(-1, w), (1, width // w))
    return out


def _room_left(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets that share a token at these places of their orders can still link: what comes before and what follows bounds the rest."""
    most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    return 9 * most >= 4 * (n[i] + n[j])


class _Pairs:
    """Pairs of ids with how often they were found. Repeated ones are counted together before they are handed on, HELD are held at most."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), HELD):
            x, y = a[at : at + HELD], b[at : at + HELD]
            self.parts.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64)]))
            self.size += len(x)
            if self.size >= HELD:
                yield from self.taken(HELD // 2)

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, if that is more than so many pairs."""
        if not self.size:
            return
        a, b, times = np.concatenate(self.parts, 1)
        order = np.lexsort((b, a))
        a, b, times = a[order], b[order], times[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        found = np.stack([a[cut], b[cut], np.add.reduceat(times, cut)])
        self.parts, self.size = [found], len(cut)
        if len(cut) > least:
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["centre", "id", "times"])


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, by size, to the pairs of its ids that the signature tree leaves, and in how many tokens' trees it does.

    Blocks come in the order of the smallest ids of their tokens' groups, so that most tokens two sets share follow each other here
    and their pair is handed on once.
    """
    names = ("token", "i", "j", "n", "at", "id", "component", "room")
    held: list[tuple] = []
    found = _Pairs()

    def pairs(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, n, at, ids, component, room, words = (np.concatenate([p[k] for p in parts]) for k in range(7))
        bits = [b for p in parts for b in p[7]]
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        widths = np.maximum.reduceat(words, cuts[:-1])
        for width in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == width)
            rows = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in mine.tolist()])
            edges = np.concatenate([[0], np.cumsum(cuts[mine + 1] - cuts[mine])])
            m, place, who, inside, spare = n[rows], at[rows], ids[rows], component[rows], room[rows]
            map_ = _same_width([bits[k] for k in rows.tolist()], words[rows], width)
            slack = m - np.bitwise_count(map_).sum(1, dtype=np.int64) * words[rows] // width

            def keep(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                enough = (_least_shared(m[i], m[j]) <= 2 * np.minimum(spare[i], spare[j])) & _room_left(m, place, i, j) & (who[i] != who[j])  # noqa: B023
                return found.add(who[i[enough]], who[j[enough]])  # noqa: B023

            for i, j in _leaf_pairs(edges, m, slack, inside, map_):
                yield from keep(i, j)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s > LEAF:
                    for i, j in SignatureTree(m[s:e], slack[s:e], inside[s:e], map_[s:e]).survivors():
                        yield from keep(i + s, j + s)

    for batch in batches:
        if not batch.num_rows:
            continue
        t, i, j, n, at, ids, component, room = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
        bits = batch.column("bits").to_pylist()
        words = np.array([len(b) // 8 for b in bits])
        key = np.stack([t, i, j], 1)
        # the last block of the batch may go on in the next one
        last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
        cut = lambda a, b: (key[a:b], n[a:b], at[a:b], ids[a:b], component[a:b], room[a:b], words[a:b], bits[a:b])  # noqa: B023, E731
        if last:
            yield from pairs([*held, cut(0, last)])
            held = []
        held.append(cut(last, None))
    yield from pairs(held)
    yield from found.taken()


def _frequent(pairs: DataFrame, sizes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs (centre, id, times) that share enough of the tokens they are indexed under.

    Of two linked sets, take the one whose last such token comes first in the order. Those of its p tokens that the other set has
    are among the other's too, so at least p - (n - overlap) of them are shared, the least overlap of a link being 4/9 of both
    sizes. Tokens of crowded groups, of which an id has `room`, count only where these could make up half of the least; elsewhere
    as many are taken off. A pair that some tree excluded counts less, but it can't link.
    """
    size = sizes.join(crowded, "id", "left").select("id", "n", F.coalesce("room", F.lit(0)).alias("room"))
    side = lambda name: size.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("room").alias(f"{name}_room"))
    least = F.expr("(4 * (centre_n + id_n) + 8) div 9 + 1 - (4 * greatest(centre_n, id_n) + 4) div 5")
    known = pairs.join(side("centre"), "centre").join(side("id"), "id")
    room = F.least("centre_room", "id_room")
    return known.where(F.col("times") >= least - F.when(least <= 2 * room, 0).otherwise(room)).select("centre", "id").distinct()


def _joined(links: DataFrame, known: DataFrame) -> DataFrame:
    """Components when more links are added to known ones: those of the graph whose vertices are the known components."""
    of = lambda name: known.select(F.col("id").alias(name), F.col("component").alias(f"{name}_in"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    more = staged(components(between, "between"), "more")
    outer = more.select(F.col("id").alias("component"), F.col("component").alias("outer"))
    moved = known.join(outer, "component", "left").select("id", F.coalesce("outer", "component").alias("component"))
    return moved.unionByName(more.join(known, "id", "left_anti"))


def _placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(token, n, at, id, component) of the postings; an id without links is its own component."""
    return shared.select("token", "n", "at", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _best(votes: DataFrame) -> DataFrame:
    """(centre, id): of each id the centre it shares most tokens with, if these promise a link. No link depends on it."""
    votes = votes.where("count * 20 >= n")
    return votes.groupBy("id").agg(F.max(F.struct("count", (-F.col("centre")).alias("c"))).alias("best")).select((-F.col("best.c")).alias("centre"), "id")


def _merged(shared: DataFrame, found: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """Components after another pass of clusters over the groups that hold several.

    All groups rank the components alike, by a seeded hash; the ids of the others are tried with a member of the first one.
    """
    placed = _placed(shared, found)
    first = F.min(F.struct(F.xxhash64("component", F.lit(seed)), "component", "id")).alias("first")
    first = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first).where("lo < hi")
    others = placed.join(first.select("token", F.col("first.component").alias("there"), F.col("first.id").alias("centre")), "token").where("component <> there")
    votes = others.groupBy("id", "centre").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("n"))
    return staged(_joined(_check(_best(votes), texts, True, "links"), found), "merged")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signatures = staged(docs.mapInArrow(_signatures, "doc_id long, n long, digest binary, bits binary"), "signatures")
    classes = staged(signatures.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id")).where("id is not null"), "classes")
    # in buckets, since every pass joins a few pairs with their texts; dealt by id first, or every task would write a file for every bucket
    dealt = docs.where("doc_id is not null").repartition(partitions(docs.sparkSession), "doc_id")
    texts = bucketed(dealt.join(classes.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "doc_id", "texts")
    held = docs.sparkSession.sparkContext.broadcast(_levels(texts))
    postings = texts.mapInArrow(_postings(held), "token long, n int, at int, id long").repartition("token").sortWithinPartitions("token", "n", "id")
    shared = staged(postings.mapInArrow(_runs, "token long, n int, at int, id long, centre long"), "shared")
    # clusters: each class is tried with the centre it shares most tokens with, and with centres that grow beside it
    # (only pairs that share so many tokens are worth a try here; the trees miss none)
    votes = shared.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("n"))
    found = staged(components(_check(_best(votes), texts, True, "links"), "clusters"), "components")
    for seed in range(MERGES):
        found = _merged(shared, found, texts, seed)
    # trees: groups that still hold several components
    placed = _placed(shared, found)
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("id").alias("lead")).where("lo < hi")
    bits = signatures.select(F.col("doc_id").alias("id"), "n", "bits")
    # a pair need not meet in a crowded group if it must share more tokens than are crowded for either of the two
    rows = placed.join(mixed.select("token", "lead", (F.col("size") > LEAF).alias("crowd"), F.expr(f"cast((size - 1) div {BLOCK} + 1 as int)").alias("k")), "token")
    crowded = staged(rows.where("crowd").groupBy("id").agg(F.count(F.lit(1)).alias("room")), "crowded")
    rows = rows.join(crowded, "id", "left").withColumn("room", F.when(F.col("crowd"), F.col("room")).otherwise(1 << 40)).join(bits, ["id", "n"])
    part = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    blocks = rows.withColumn("part", part).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    # tokens with the same first id go to one task, so that their pairs are counted there; those of larger groups to several
    apart = F.when(F.col("k") > 1, F.col("token")).when(F.col("crowd"), F.pmod("token", F.lit(SPREAD))).alias("apart")
    blocks = blocks.select("lead", apart, "token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "n", "at", "id", "component", "room", "bits")
    blocks = blocks.repartition("lead", "apart", "i", "j").sortWithinPartitions("lead", "token", "i", "j", "n", "id").drop("lead", "apart")
    pairs = blocks.mapInArrow(_traverse, "centre long, id long, times long").groupBy("centre", "id").agg(F.sum("times").alias("times"))
    left = staged(_frequent(pairs, bits, crowded), "left")
    found = staged(_joined(_check(left, texts, False, "more-links"), found), "joined")
    # components go to the classes first: a class may be a large part of all rows
    where = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    whole = signatures.where("n > 0").join(where, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return whole.unionByName(signatures.where("n = 0").withColumn("component_id", F.col("doc_id"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Query: the component of every document."""
    return jaccard_components(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the row with the smallest doc_id.

    Of rows that share this id one stays; rows without an id, or without shingles, stay.
    """
    found = jaccard_components(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("c"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"))
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row.text").desc_nulls_last()))
    known = packed.join(found.where("c = id"), F.col("doc") == F.col("id")).withColumn("one", one).where("one = 1 or n = 0").select("row")
    return known.unionByName(packed.where("doc is null").select("row")).select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
