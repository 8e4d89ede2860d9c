"""Detection of runs: maximal stretches of words that repeat with some period.

All runs of a text are found by way of its longest previous factors. A suffix array sorted by doubling leaves ranks of the words from each place on, 1, 2, 4, ... long;
two places' common extension, forward or backward, is read off these ranks. The nearest smaller places on either side of a place in the suffix array, with the extensions (LCP) there, give
the longest factor that has begun before, and these lengths cut the text into blocks (LZ). A run that touches a border between blocks has a period of fewer
words than both blocks together, so it comes from extending a pair of places that far apart across the border in both directions (Main). A run inside a block is the copy of one in the block's source: runs lie in
buckets by their start, and each block copies from its source's buckets, from left to right.

Before that, words are left out that cannot lie in a run: a run of length >= LEAST and period q repeats at least min(LEAST, 2 q) - q >= LEAST / 2 words at distance q, so every word of it lies in LEAST / 2
neighbouring words that occur twice in the text. Stretches of such words are what the steps above work on, many texts' at a time; their numbers tell texts apart. (Equal hashes of different words only let more through.)

Nothing is shuffled: texts are read where they lie, and the memory of a task follows BATCH words or the longest text. Within it all steps are arrays, but for the chain of
neighbours, the cuts into blocks and the copies.

Defined results: a NULL or empty text has no words, no runs and an empty collapsed text. Rows that repeat a doc_id are documents of their own; an empty table has an empty result; only doc_id and text are read of the table's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfield.llm.common import read

LEAST = 12
BATCH = 400_000
#: Pairs of places that are extended at once.
AT_ONCE = 1_000_000


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and the controls 9 to 13."""
    return text.encode().split() if text else []


class Extensions:
    """Common extensions of places of a sequence of numbers, whose last number occurs once."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.ranks = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
        while int(self.ranks[-1].max(initial=0)) < n - 1:
            rank, h = self.ranks[-1].astype(np.int64), 1 << len(self.ranks) - 1
            later = np.zeros(n, np.int64)
            later[: n - h] = rank[h:] + 1
            self.ranks.append(np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int32))
        #: places in the order of the suffixes
        self.array = np.argsort(self.ranks[-1])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from a on equal those from b on."""
        n, size = len(self.array), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + size, b + size
            # places so near the end that the rank would reach beyond it are compared by shorter ones
            fits = (x + (1 << k) <= n) & (y + (1 << k) <= n)
            same = fits & (self.ranks[k][np.where(fits, x, 0)] == self.ranks[k][np.where(fits, y, 0)])
            size += same.astype(np.int64) << k
        return size

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before a equal those before b."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - size - (1 << k), b - size - (1 << k)
            fits = (x >= 0) & (y >= 0)
            same = fits & (self.ranks[k][np.where(fits, x, 0)] == self.ranks[k][np.where(fits, y, 0)])
            size += same.astype(np.int64) << k
        return size


def previous_factors(e: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(length, source): the longest factor from each place on that begins at an earlier place too, and such a place."""
    n = len(e.array)
    rank = np.empty(n, np.int64)
    rank[e.array] = np.arange(n)
    around = np.concatenate([[-1], e.array, [-1]])
    before, after = around[rank].tolist() + [-1], around[rank + 2].tolist() + [-1]
    # places leave the chain from the last one on, so a place's neighbours are then the nearest smaller ones; -1, no place, has the entry behind the last
    for i in range(n - 1, -1, -1):
        a, b = before[i], after[i]
        after[a] = b
        before[b] = a
    before, after, here = np.array(before[:n]), np.array(after[:n]), np.arange(n)
    lengths = [np.where(s >= 0, e.forward(np.maximum(s, 0), here), 0) for s in (before, after)]
    return np.maximum(*lengths), np.where(lengths[0] >= lengths[1], before, after)


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the blocks and the end of the text."""
    steps, at, out = np.maximum(length, 1).tolist(), 0, []
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array([*out, at])


def _crossing(e: Extensions, cuts: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of the stretches that touch a border, by extension."""
    n = len(e.array)
    sizes = np.diff(cuts)
    reach = np.concatenate([[0], sizes]) + np.concatenate([sizes, [0]])
    found = [np.zeros((0, 3), np.int64)]
    ends = np.cumsum(reach)
    at = 0
    while at < len(cuts):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")), at + 1)
        border = np.repeat(cuts[at:to], reach[at:to])
        period = np.arange(len(border)) - np.repeat(ends[at:to] - reach[at:to] - (ends[at - 1] if at else 0), reach[at:to]) + 1
        for a in (border, border - period):
            ok = (a >= 0) & (a + period < n)
            a, p = a[ok], period[ok]
            # most pairs end at once: those whose first numbers differ on both sides go without the longer ranks
            r = e.ranks[0]
            near = (r[a] == r[a + p]) | ((a > 0) & (r[a - 1] == r[a + p - 1]))
            a, p = a[near], p[near]
            start, end = a - e.backward(a, a + p), a + p + e.forward(a, a + p)
            long = end - start >= np.maximum(least, 2 * p)
            found.append(np.stack([start, end, p], 1)[long])
        at = to
    return np.concatenate(found)


def runs(text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period), in order, of all runs of at least so many numbers. The last number occurs once."""
    e = Extensions(text)
    length, source = previous_factors(e)
    cuts = blocks(length)
    found = _crossing(e, cuts, least)
    # a stretch is found with multiples of its period, too: the least one stays
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    # buckets by start, in which a block finds what its source holds; a block's copies may be sources of its own
    bucket: dict[int, dict[int, int]] = {}
    for s, t, p in found.tolist():
        bucket.setdefault(s, {})[t] = p
    if bucket:
        filled = np.zeros(len(text), bool)
        filled[list(bucket)] = True
        for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if t - s < least + 2:
                continue
            back = s - int(source[s])
            at = s - back + 1
            while at + least < t - back:
                ahead = int(filled[at : t - back - least].argmax()) + at
                if not filled[ahead]:
                    break
                for end, p in list(bucket[ahead].items()):
                    if end < t - back:
                        bucket.setdefault(ahead + back, {})[end + back] = p
                        filled[ahead + back] = True
                at = ahead + 1
    return np.array(sorted((s, t, p) for s, ends in bucket.items() for t, p in ends.items()), np.int64).reshape(-1, 3)


def _repeated(hashes: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in so many neighbouring words of a document that occur in it twice, by hashes."""
    n = len(hashes) - size + 1
    if n < 2:
        return np.zeros(len(hashes), bool)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h += doc[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= doc[:n] == doc[size - 1 :]
    steps = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(twice)
    steps[at] += 1
    steps[at + size] -= 1
    return np.cumsum(steps[:-1]) > 0


def batch_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period), in order, of the runs of each text."""
    sizes = np.array([len(t) for t in texts])
    out: list[list] = [[] for _ in texts]
    if not sizes.sum():
        return out
    hashes = np.concatenate([np.fromiter(map(hash, t), np.int64, len(t)) for t in texts]).view(np.uint64)
    doc, begins = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    inside = _repeated(hashes, doc, least // 2)
    # stretches: neighbouring words of one document
    edge = np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8))
    first, last = edge[:-1] == 1, edge[1:] == -1
    border = inside[1:] & inside[:-1] & (doc[1:] != doc[:-1])
    first[1:] |= border
    last[:-1] |= border
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    numbers: dict[tuple[int, bytes], int] = {}
    flat: list[int] = []
    placed = []
    for k, (s, t) in enumerate(zip(starts[long].tolist(), ends[long].tolist(), strict=True)):
        d = int(doc[s])
        flat += [numbers.setdefault((k, w), len(numbers)) for w in texts[d][s - int(begins[d]) : t - int(begins[d])]]
        placed.append((len(flat), d, s - int(begins[d])))
        flat.append(numbers.setdefault((k, b""), len(numbers)))
    if not flat:
        return out
    found = runs(np.array(flat, np.int64), least)
    after = np.array([p[0] for p in placed])
    for s, t, p in found.tolist():
        k = int(np.searchsorted(after, s))
        _, d, begin = placed[k]
        out[d].append((s - (placed[k - 1][0] + 1 if k else 0) + begin, t - s, p))
    return out


def collapsed(text: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind a run's first period, with one space between them."""
    if not found:
        return b" ".join(text)
    keep = np.ones(len(text), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(text, keep.tolist(), strict=True) if k)


_RUNS = "array<struct<start:long,length:long,period:long>>"
_DDL = f"doc_id long, n_words long, runs {_RUNS}, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


def find_runs(docs: DataFrame, least: int = LEAST, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every document's runs (start, length, period), by start and period, and its text without their repetitions."""
    if least < 4 or least % 2:
        raise ValueError("an even least length of 4 or more")

    def found(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        all_runs = batch_runs(texts, least)
        names = ("start", "length", "period")
        columns = [ids, [len(t) for t in texts], [[dict(zip(names, r, strict=True)) for r in sorted(x, key=lambda r: (r[0], r[2]))] for x in all_runs], [collapsed(t, x).decode() for t, x in zip(texts, all_runs, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for part in batches:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(words(text))
                size += len(texts[-1])
                if size >= batch:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield found(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DDL)


def planted(doc_id, text):
    """A text that is periodic from some word on where 10 divides the crc32 of its id, as a Column; other texts as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    w = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    # arrays of one bind what would else be computed for every word
    start = lambda w: F.struct(w.alias("w"), (g % F.size(w)).alias("a"), (3 + g % 8).alias("parts"))
    bound = lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((F.size(s["w"]) - s["a"]) / s["parts"])).alias("p"))
    body = lambda s: F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int"))))
    made = F.array(w)
    for step in (start, bound, body):
        made = F.transform(F.filter(made, lambda x: F.size(x) > 0) if step is start else made, step)
    return F.when(h % 10 == 0, F.coalesce(F.array_join(F.get(made, 0), " "), text)).otherwise(text)


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    """Query: the runs of every document, some of them made periodic, and digests of the runs and of the collapsed text."""
    docs = read(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.length"), F.col("best.period")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
