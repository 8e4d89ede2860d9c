"""Harmonic packing of tokenised documents into sequences.

A document's ids are cut into pieces whose lengths lie in reciprocal-capacity classes: whole sequences first, then
the rest by halves (1024, 512, ... down to SMALLEST), then a remnant shorter than SMALLEST. The class of a piece of
length L is k = floor(capacity / L), and a bin of the class holds exactly k pieces of that length. Each worker fills
its bins alone and streams out every full one. The pieces left in its open bins, fewer than k for each length, are
ranked within their class over all workers and fill bins there; the last open bin of a class with a halved length
is split into sequences whose lengths are powers of two, which need no padding. Only remnants in the last bin of
their class are mixed with each other.

Defined results: a null or empty text is one id, the end mark. Rows that repeat a doc_id are documents of their own. Very
long texts are cut like all others; memory follows one text and the open bins (at most capacity ids for a class). An empty table has an
empty result; of the table's columns only doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import arrow_batches, read, staged

CAPACITY = 2048
#: Remnants are shorter than this, so a full bin of them wastes less than SMALLEST ids.
SMALLEST = 64
END = 1
#: Characters of words' stems kept with their ids by a worker before it drops those that were not asked for again.
STEM_CHARS = 2_000_000
#: Characters tokenized at once; a longer text is cut after a space or line feed, if it has any.
AT_ONCE = 4_000_000
#: Stems of letters alone that are tokenized as one text; the ids that end words tell them apart.
TOGETHER = 64
#: Bytes of texts in a batch that a worker gets at once; Spark's own bound of rows would make batches of tens of MB.
BATCH_BYTES = 2 << 20
#: Texts given to the tokenizer in one call.
CALL = 128
#: Signs that are split from a word's end.
SIGNS = ".,;:!?*$%#)\"'-"

_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, bin long, slot long"
_PIECE = pa.schema([(x.split()[0], pa.int64()) for x in _PIECE_DDL.split(", ")])


def tokenizer_path() -> str:
    """The vocabulary file of the query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _stays(c: str) -> bool:
    """Whether a character is a letter or digit, and still ends as one when the vocabulary has composed and lower-cased it, which can leave a mark behind a letter."""
    return c.isalnum() and unicodedata.normalize("NFC", c).lower()[-1].isalnum()


#: The normalizer and pre-tokenizer that only lower-case and split a text of Latin letters and spaces.
BEFORE_IDS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]


def _letters(tokenizer, path: str):
    """The same vocabulary for lower-case Latin letters between spaces, without the steps that leave these as they are; None if it has other steps."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = json.loads(Path(path).read_bytes())
    if [steps["normalizer"], steps["pre_tokenizer"]] != BEFORE_IDS:
        return None
    found = Tokenizer(tokenizer.model)
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


class WordEncoder:
    """Ids of a text, by the ids of its words.

    The vocabulary's pre-tokenizer never joins characters across a space or line feed, so the ids of a text are those
    of the stretches between them, and each distinct stretch is put together once for some thousand texts: from its stem and the
    signs at its end, which the pre-tokenizer separates from a letter or digit before them. Only new stems and signs are tokenized.
    Most stems occur in one stretch of texts alone, so those that occur again are the ones worth their memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: whether an id is the last of what the pre-tokenizer keeps together; None if the vocabulary doesn't tell
        self.ends: np.ndarray | None = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.letters = _letters(self.tokenizer, path)
        self._forget()

    def _forget(self) -> None:
        """Start with the empty stem alone. A stem's number tells where its ids start; the next one's, where they end."""
        self.known, self.ids, self.starts, self.again, self.chars = {"": 0}, array("I"), array("q", [0, 0]), bytearray(1), 0

    def _thin(self) -> None:
        """Keep the stems that a later stretch of texts has asked for since they were kept or last thinned; none, if these are too many."""
        self.again[0] = 1
        again, starts = np.array(self.again, bool), np.array(self.starts)
        place = (np.cumsum(again) - 1).tolist()
        known = {w: place[n] for w, n in self.known.items() if self.again[n]}
        sizes = np.diff(starts)[again]
        ids = _gather(np.array(self.ids), starts[:-1][again], sizes)
        self._forget()
        if (chars := sum(map(len, known))) <= STEM_CHARS // 2:
            self.known, self.chars, self.again = known, chars, bytearray(len(sizes))
            self.ids.frombytes(ids.tobytes())
            self.starts = array("q", [0])
            self.starts.frombytes(np.cumsum(sizes).tobytes())

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """The stem and the signs at a word's end; the word as it is where these might be one token."""
        stem = word.rstrip(SIGNS)
        return (stem, word[len(stem) :]) if stem and _stays(stem[-1]) else (word, "")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four little-endian bytes each. All that is new in a stretch of texts is tokenized in one call."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in self.cut(text):
                held.append((k, piece))
                size += len(piece)
                if size >= AT_ONCE:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    @staticmethod
    def cut(text: str) -> Iterator[str]:
        """A text in pieces that end with spaces or line feeds, of about AT_ONCE characters each."""
        while len(text) > AT_ONCE:
            at = max(text.rfind(" ", 0, AT_ONCE), text.rfind("\n", 0, AT_ONCE))
            if at < 0:
                after = [p for p in (text.find(" ", AT_ONCE), text.find("\n", AT_ONCE)) if p >= 0]
                if not after:
                    break
                at = min(after)
            yield text[: at + 1]
            text = text[at + 1 :]
        yield text

    def _encode(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        texts = pc.replace_substring(pa.array([t for _, t in held], pa.large_string()), "\n", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        # a distinct word's ids are its stem's and its signs'
        parts = pa.concat_arrays(self._parts(words.dictionary)).dictionary_encode()
        number = self._numbers(parts.dictionary)[parts.indices.to_numpy().reshape(2, -1).T.ravel()]
        starts = np.frombuffer(self.starts, np.int64)
        sizes = starts[number + 1] - starts[number]
        ids = _gather(np.frombuffer(self.ids, np.uint32), starts[number], sizes)
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        word = words.indices.to_numpy()
        ids = _gather(ids, (np.cumsum(sizes) - sizes)[word], sizes[word]).astype("<u4", copy=False)
        bounds = np.concatenate([[0], np.cumsum(sizes[word])])[split.offsets.to_numpy()].tolist()
        for (k, _), start, end in zip(held, bounds[:-1], bounds[1:], strict=True):
            out[k].append(ids[start:end].tobytes())

    @classmethod
    def _parts(cls, words: pa.Array) -> list[pa.Array]:
        """The stems and the signs of distinct words, as parts() has them."""
        stems = pc.ascii_rtrim(words, SIGNS)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        apart = pa.array([bool(cls.parts(c + ".")[1]) for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        stems = pc.if_else(apart, stems, words)
        # signs are ASCII: as many characters as bytes
        n_signs = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        signed = np.flatnonzero(n_signs)
        signs = np.full(len(words), "", object)
        signs[signed] = [w[-n:] for w, n in zip(words.take(pa.array(signed)).to_numpy(zero_copy_only=False), n_signs[signed].tolist(), strict=True)]
        return [stems, pa.array(signs, words.type)]

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct stems and signs."""
        if self.chars > STEM_CHARS:
            self._thin()
        names = parts.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        missing = [k for k, x in enumerate(found) if x is None]
        np.frombuffer(self.again, np.uint8)[[x for x in found if x is not None]] = 1
        new = [names[k] for k in missing]
        self._tokenize(new)
        self.chars += sum(map(len, new))
        for k, x in zip(missing, map(self.known.__getitem__, new), strict=True):
            found[k] = x
        return np.array(found, np.int64)

    def _tokenize(self, new: list[str]) -> None:
        """Number distinct stems and signs and keep their ids. Of Latin letters alone, forms that differ in case share a number."""
        alpha = list(filter(str.isalpha, new)) if self.ends is not None else []
        latin = [w for w in alpha if w.isascii() or max(w) < "\u0100"] if self.letters else []
        lower = list(map(str.lower, latin))
        rest = list(set(new).difference(alpha))
        rest += self._together(self.letters, list(set(lower).difference(self.known)))
        rest += self._together(self.tokenizer, list(set(alpha).difference(latin)))
        for x, e in zip(rest, _encodings(self.tokenizer, rest), strict=True):
            ids = e.ids
            self._keep([x], np.array(ids, np.uint32), np.array([len(ids)]))
        self.known.update((w, self.known[x]) for w, x in zip(latin, lower, strict=True) if w != x)

    def _together(self, tokenizer, stems: list[str]) -> list[str]:
        """Keep stems of letters alone, many in one text; those are returned that the vocabulary takes apart."""
        apart: list[str] = []
        at_once = [stems[i : i + TOGETHER] for i in range(0, len(stems), TOGETHER)]
        for part, e in zip(at_once, _encodings(tokenizer, [" ".join(p) for p in at_once]), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._keep(part, ids, ends)
            else:
                apart += part
        return apart

    def _keep(self, names: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.starts) - 1, len(self.starts) - 1 + len(names)), strict=True))
        self.starts.frombytes((ends + len(self.ids)).tobytes())
        self.again.extend(bytes(len(names)))
        self.ids.frombytes(ids.tobytes())


def _encodings(tokenizer, texts: list[str]) -> Iterator:
    """What the tokenizer makes of each text. An encoding takes many times its ids' memory, so only CALL are made at once."""
    for at in range(0, len(texts), CALL):
        yield from tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(sizes.sum()) + np.repeat(starts - ends + sizes, sizes)]


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out, at = [(i * capacity, capacity) for i in range(n // capacity)], n // capacity * capacity
    size = capacity // 2
    while size >= smallest:
        if n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    return [*out, (at, n - at)] if at < n else out


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, capacity: int, smallest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        worker, bins = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple]] = {}
        end = END.to_bytes(4, "little")

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal bins
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 1_000):
                for doc_id, data in zip(ids[at : at + 1_000], encoder.encode(texts[at : at + 1_000]), strict=True):
                    data += end
                    n = len(data) // 4
                    for start, length in cuts(n, capacity, smallest):
                        piece = (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n)
                        mine = waiting.setdefault(length, [])
                        mine.append(piece)
                        if len(mine) == capacity // length:
                            yield from ((*p, worker, bins, slot) for slot, p in enumerate(mine))
                            mine.clear()
                            bins += 1

        def block(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_PIECE) if found else pa.RecordBatch.from_pylist([], _PIECE)

        for batch in batches:
            yield block(list(rows(batch)))
            pa.default_memory_pool().release_unused()
        yield block([(*p, worker, None, slot) for mine in waiting.values() for slot, p in enumerate(mine)])

    return run


def harmonic_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """Pieces of all documents with the sequence and offset they get.

    Leftovers are ranked by the workers' counts: only the table of counts, a row for a length and worker, is summed up along the
    workers. What is left of the last bins is fewer than capacity / length pieces of a length, whatever the number of workers.
    """
    if capacity & capacity - 1 or smallest & smallest - 1:
        raise ValueError("capacity and smallest are powers of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        pieces = staged(rows.mapInArrow(_pieces(path, capacity, smallest), _PIECE_DDL), "pieces")
    full = pieces.where("bin is not null").select(*pieces.columns[:5], F.expr("shiftleft(worker, 34) + bin").alias("sequence_id"), (F.col("slot") * F.col("length")).alias("offset"))
    left = pieces.where("bin is null")
    along, whole_length = Window.partitionBy("length").orderBy("worker"), Window.partitionBy("length")
    counts = left.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("length", "worker", before.alias("before"), F.sum("n").over(whole_length).alias("count"))
    k = F.expr(f"cast({capacity} div length as long)")
    left = left.join(places, ["length", "worker"]).withColumns({"rank": F.col("before") + F.col("slot"), "k": k})
    whole = F.col("rank") < F.expr("count div k * k")
    # sequence ids from 2^60 on; the length marks the class
    base = F.expr(f"{1 << 60} + shiftleft(length, 40)")
    pooled = left.where(whole).select(*pieces.columns[:5], (base + F.expr("rank div k")).alias("sequence_id"), F.expr("rank % k * length").alias("offset"))
    # the open bin of a halved length: m pieces as sequences of 2^i pieces, the largest first
    m, r = F.expr("count % k"), F.expr("rank - count div k * k")
    halved = left.where(~whole & (F.col("length") >= smallest)).withColumns({"m": m, "r": r})
    # in m's binary digits, a piece r belongs to the highest power whose sequences end after r
    first = F.lit(0).cast("long")
    size = F.lit(None).cast("long")
    for i in range((capacity // smallest).bit_length()):
        p = 1 << i
        above = F.expr(f"cast(m div {2 * p} * {2 * p} as long)")
        here = F.expr(f"(m & {p}) > 0") & (F.col("r") >= above) & (F.col("r") < above + p)
        size, first = F.when(here, F.lit(p)).otherwise(size), F.when(here, above).otherwise(first)
    halved = halved.withColumns({"p": size, "first": first})
    halved = halved.select(*pieces.columns[:5], (base + F.expr(f"{1 << 39} + p")).alias("sequence_id"), ((F.col("r") - F.col("first")) * F.col("length")).alias("offset"))
    # remnants of the last bins: at most capacity ids for each of fewer than smallest lengths
    order = Window.orderBy(F.desc("length"), "rank")
    last = left.where(~whole & (F.col("length") < smallest)).drop("before").withColumn("before", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    last = last.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("bin", F.expr(f"before div {capacity - smallest + 1}"))
    start = F.min("before").over(Window.partitionBy("bin"))
    last = last.select(*pieces.columns[:5], (F.lit(1 << 61) + F.col("bin")).alias("sequence_id"), (F.col("before") - start).alias("offset"))
    return full.unionByName(pooled).unionByName(halved).unionByName(last)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents packed into sequences of 2048 ids."""
    return harmonic_pack(read(spark, sf_dir, "documents"), tokenizer_path())
