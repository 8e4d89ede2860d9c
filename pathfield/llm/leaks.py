"""Benchmark decontamination by suffix arrays of the training documents.

Documents are read in shards: as many whole documents of a partition as hold about SHARD words. A shard's words become numbers (0 for a word that
no benchmark item has, and between documents), and its suffix array lists the places in the order of what follows them: sorted by packed words first and then by
ranks that reach three times as far each time, up to the longest item. Every suffix of every item is looked up in it by binary search, all at once: the range of suffixes that
begin with its window (WINDOW words, or the whole item if that is shorter) gives all verbatim occurrences, and the neighbour of its full length gives the shard's longest match and its location.

What is found stays with its document, so nothing is shuffled: a document comes back with the spans of words inside any occurrence, the items that occur and the longest matches
located in it. `clean` removes the documents with any; `longest_matches` takes the maximum over all shards.

Items are broadcast in blocks of at most BLOCK bytes of text, so the benchmark may have any size; with several blocks the documents are numbered and staged once, and a document's
findings of all blocks meet in one grouping.

Defined results: a NULL or empty text has no words; an item without words is in no document; items that repeat an id count once, with the windows of all their texts; an item without an id
marks words but is not listed. Rows that repeat a doc_id are documents of their own. Very long texts are searched whole: a shard has at least one document. Empty tables: no rows, or nothing found. Of
the tables' columns only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfield.llm.common import read, staged

WINDOW = 10
SHARD = 1_000_000
BLOCK = 16 << 20

#: Bytes that belong to words stay, A-Z in lower case; all others of ASCII separate words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


class TestSuffixes:
    """Every window of a set of items, distinct, with the items' words as numbers from 1 on."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.ids = sorted({i for i, _ in split if i is not None}, key=str)
        place = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        flat, starts, lengths, owners = [], [], [], []
        self.offsets = []  # of each suffix in its item
        for i, w in split:
            at, n = len(flat), len(w)
            flat += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            flat.append(0)
            many = max(n - window, 0) + 1
            starts += range(at, at + many)
            lengths += [min(n, window)] * many
            owners += [place.get(i, -1)] * many
            self.offsets += range(many)
        #: words of all items, each item ending with 0; padded so that any suffix can be read to the longest item's length
        self.longest = max((len(w) for _, w in split), default=0)
        self.text = np.array(flat + [0] * (self.longest + 1), np.int64)
        self.start, self.length, self.owner = (np.array(x, np.int64) for x in (starts, lengths, owners))
        self.offsets = np.array(self.offsets, np.int64)
        self.least = int(self.length.min()) if len(self.length) else 0
        # suffixes with the same window share its occurrences: kind numbers the distinct ones
        reach = np.arange(window)
        shown = np.where(reach < self.length[:, None], self.text[np.minimum(self.start[:, None] + reach, len(self.text) - 1)], 0)
        _, self.first, self.kind = np.unique(shown, axis=0, return_index=True, return_inverse=True) if len(shown) else (None, np.zeros(0, int), np.zeros(0, int))
        self.kind = self.kind.ravel()


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Places of words other than 0 in the order of the `reach` words from there on; places equal so far follow in any order."""
    n, places = len(text), np.flatnonzero(text)
    rank, covered = text, 1
    while True:
        bits = max(int(rank.max(initial=0)).bit_length(), 1)
        parts = max(63 // bits, 2)
        if parts * bits > 63:
            raise ValueError("a shard has at most 2^31 words")
        key = np.zeros(len(places), np.int64)
        for k in range(parts):
            at = places + k * covered
            key = key << bits | np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        covered *= parts
        order = np.argsort(key)
        if covered >= reach or not len(order):
            return places[order]
        key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[places[order]] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        if len(key) and fresh.max() == len(places):
            return places[order]
        rank = fresh


def _bounds(text: np.ndarray, array: np.ndarray, wanted: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """For rows of wanted words, so many of which count: the first place in the array, within [low, high), not below them, or above them if after."""
    low, high = low.copy(), high.copy()
    reach = np.arange(wanted.shape[1])
    inside = reach < lengths[:, None]
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo]) >> 1
        here = text[np.minimum(array[mid][:, None] + reach, len(text) - 1)]
        apart = (here != wanted[todo]) & inside[todo]
        k = apart.argmax(1)
        row = np.arange(len(todo))
        below = np.where(apart[row, k], here[row, k] < wanted[todo, k], after)
        low[todo[below]] = mid[below] + 1
        high[todo[~below]] = mid[~below]
    return low


def search(text: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(places, kinds, longest): every occurrence of every distinct window in a shard, and (suffix, place, length) of each found suffix's longest match.

    text ends with 0.
    """
    array = suffix_array(text, tests.longest)
    window = int(tests.length.max())
    firsts = tests.start[tests.first]
    wanted, lengths = tests.text[np.minimum(firsts[:, None] + np.arange(window), len(tests.text) - 1)], tests.length[tests.first]
    low = _bounds(text, array, wanted, lengths, np.zeros(len(firsts), np.int64), np.full(len(firsts), len(array)), False)
    high = _bounds(text, array, wanted, lengths, low, np.full(len(firsts), len(array)), True)
    times = high - low
    kinds = np.repeat(np.arange(len(firsts)), times)
    places = array[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    found = np.flatnonzero(times[tests.kind])
    longest: list[tuple[int, int, int]] = []
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        full = tests.text[np.minimum(tests.start[part][:, None] + np.arange(tests.longest), len(tests.text) - 1)]
        # words behind the item's end are not part of the suffix
        ends = np.where((full == 0).any(1), (full == 0).argmax(1), tests.longest)
        a, b = low[tests.kind[part]], high[tests.kind[part]]
        mid = _bounds(text, array, full, ends, a, b, False)
        sides = []
        for side in (np.maximum(mid - 1, a), np.minimum(mid, b - 1)):
            place = array[side]
            same = (text[np.minimum(place[:, None] + np.arange(tests.longest), len(text) - 1)] == full) & (np.arange(tests.longest) < ends[:, None])
            sides.append((np.where(same.all(1), tests.longest, (~same).argmax(1)), place))
        better = sides[1][0] > sides[0][0]
        longest += zip(part.tolist(), np.where(better, sides[1][1], sides[0][1]).tolist(), np.where(better, sides[1][0], sides[0][0]).tolist(), strict=True)
    return places, kinds, longest


_SPAN, _MATCH = "array<struct<start:long,end:long>>", "array<struct<item_id:string,item_start:long,start:long,length:long>>"
_DDL = f"row long, doc_id long, n_words long, spans {_SPAN}, items array<string>, longest {_MATCH}"
_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
     ("longest", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))]
)


def _findings(held, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSuffixes = held.value
        number = tests.vocabulary.get
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, parts, size
            out = _documents(rows, np.concatenate([*parts, np.zeros(1, np.int64)]), tests)
            rows, parts, size = [], [], 0
            return out

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                w = words(text)
                rows.append((row, doc_id, len(w), size))
                parts.append(np.fromiter((number(x, 0) for x in w), np.int64, len(w)))
                parts.append(np.zeros(1, np.int64))
                size += len(w) + 1
                if size >= shard:
                    yield flush()
        if rows:
            yield flush()

    return run


def _documents(rows: list[tuple], text: np.ndarray, tests: TestSuffixes) -> pa.RecordBatch:
    """The findings of a shard by document. rows: (row, doc_id, number of words, place of the first one)."""
    begins = np.array([r[3] for r in rows], np.int64)
    spans: list[list] = [[] for _ in rows]
    items: list[list] = [[] for _ in rows]
    longest: list[list] = [[] for _ in rows]
    if len(tests.start):
        places, kinds, best = search(text, tests)
        # words inside any occurrence: where more have begun than ended
        steps = np.bincount(places, minlength=len(text) + 1) - np.bincount(places + tests.length[tests.first][kinds], minlength=len(text) + 1)[: len(text) + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(steps) > 0, [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            d = int(np.searchsorted(begins, a, "right")) - 1
            spans[d].append({"start": a - rows[d][3], "end": b - rows[d][3]})
        # documents and windows, each pair once, then the windows' items
        doc = np.searchsorted(begins, places, "right") - 1
        met = np.unique(doc * len(tests.first) + kinds)
        pairs = np.unique(np.stack([tests.kind, tests.owner], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        at, to = (np.searchsorted(pairs[:, 0], met % len(tests.first), side) for side in ("left", "right"))
        for d, a, b in zip((met // len(tests.first)).tolist(), at.tolist(), to.tolist(), strict=True):
            items[d] += pairs[a:b, 1].tolist()
        for suffix, place, length in best:
            d = int(np.searchsorted(begins, place, "right")) - 1
            owner = tests.owner[suffix]
            longest[d].append({"item_id": str(tests.ids[owner]) if owner >= 0 else None, "item_start": int(tests.offsets[suffix]), "start": place - rows[d][3], "length": length})
    columns = [*zip(*[r[:3] for r in rows], strict=True), spans, [sorted({str(tests.ids[k]) for k in x}) for x in items], longest]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items in lists of at most so many bytes of text, or of one item; the driver holds one list at a time."""
    rows, size = [], 0
    for item, text in benchmark.select("item_id", F.col("text").cast("string")).where("text is not null").toLocalIterator():
        n = len(text.encode())
        if rows and size + n > block:
            yield rows
            rows, size = [], 0
        rows.append((item, text))
        size += n
    yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items, longest) of every document.

    spans: (start, end) of words inside occurrences, apart from each other; items: ids, as text, in order; longest: (item_id, item_start, start, length) of
    each item suffix whose longest match in its shard is located here.
    """
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(TestSuffixes(rows, window)) for rows in _blocks(benchmark, block)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(held) == 1:
        return rows.mapInArrow(_findings(held[0], shard), _DDL).drop("row")
    rows = staged(rows, "texts")
    found = rows.mapInArrow(_findings(held[0], shard), _DDL)
    for other in held[1:]:
        found = found.unionByName(rows.mapInArrow(_findings(other, shard), _DDL))
    flat = lambda c: F.flatten(F.collect_list(c))
    met = found.groupBy("row", "doc_id", "n_words").agg(F.array_sort(flat("spans")).alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), flat("longest").alias("longest"))
    return met.select("doc_id", "n_words", _united(F.col("spans")).alias("spans"), "items", "longest")


def _united(spans):
    """Ordered spans without overlaps: a span that begins at or before the last end joins it."""
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    step = lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), longer(done, s)).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast(_SPAN), step)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose text holds any window of the benchmark; rows of equal id and text go or stay together."""
    name = "__leak_row"
    while name in docs.columns:
        name += "_"
    rows = staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    marks = find_leaks(rows.select(F.col(name).alias("doc_id"), "text"), benchmark, window).where(F.size("spans") > 0)
    return rows.join(marks.select(F.col("doc_id").alias(name)), name, "left_anti").select(*docs.columns)


def longest_matches(found: DataFrame) -> DataFrame:
    """(item_id, item_start, length, doc_id, start) of find_leaks' rows: each item suffix's longest verbatim match over all shards, ties to the smallest doc_id and place."""
    rows = found.select("doc_id", F.explode("longest").alias("m")).select("doc_id", "m.*")
    best = F.max_by(F.struct("doc_id", "start", "length"), F.struct("length", -F.col("doc_id"), -F.col("start")))
    return rows.groupBy("item_id", "item_start").agg(best.alias("b")).select("item_id", "item_start", "b.length", "b.doc_id", "b.start")


def op12_leaks(spark, sf_dir: str) -> DataFrame:
    """Query: every document's words and items that it shares with the benchmark."""
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
