"""Document fingerprints by a quartile bucket digest.

Every byte triplet in a sliding window of four bytes is hashed into one of 128 buckets. The digest keeps, for
each bucket, the quartile its count falls into, beside the text's length on a logarithmic scale and the ratios
of the quartiles. Two digests are compared by a difference that grows with every bucket's distance, bounded and
turned into a likeness from 0 to 1.

Defined results: a null text counts as empty; texts under three bytes have an all-zero body; equal texts have equal
fingerprints; very long texts are counted in slices, so memory follows the batch and not the text's windows; an empty table has an empty
result; of the table's columns only doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import partitions, read

BUCKETS = 128
#: Positions, within four bytes, of the triplets that are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: A difference of this size or more means no likeness.
MOST = 300
SLICE = 1 << 18
#: Sampled rows for each range, order of the rows.
SAMPLE = 20
_ORDER = [("key", np.int64), ("tie", np.int64)]
_LOG = math.log(1.15)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of the bytes fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SLICE):
        b = np.frombuffer(data[at : at + SLICE + 3], np.uint8).astype(np.uint32)
        for k, (i, j, m) in enumerate(TRIPLETS):
            n = min(len(b) - m, SLICE)
            if n <= 0:
                continue
            x = b[i : i + n] * np.uint32(0x9E3779B1)
            x += b[j : j + n] * np.uint32(0x85EBCA77)
            x += b[m : m + n] * np.uint32(0xC2B2AE3D)
            x += np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(x >> np.uint32(25), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Digest of a text's UTF-8 bytes: 2 hex digits of length, 2 of quartile ratios, 64 of bucket quartiles."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    quads = codes.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8)
    length = min(255, round(math.log(len(data) + 1) / _LOG))
    ratios = (15 * int(q1) // max(int(q3), 1)) << 4 | 15 * int(q2) // max(int(q3), 1)
    return bytes([length, ratios]).hex() + body.tobytes().hex()


def _codes(digest: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(digest[4:]), np.uint8)
    return np.stack([body >> 6 & 3, body >> 4 & 3, body >> 2 & 3, body & 3], 1).ravel().astype(np.int16)


#: Cost of two buckets that lie so many quartiles apart.
_COST = np.array([0, 1, 2, 6])


def difference(a: str, b: str) -> int:
    """Difference of two digests: 0 for equal ones, MOST at the most."""
    if a == b:
        return 0
    body = int(_COST[np.abs(_codes(a) - _codes(b))].sum())
    length = abs(int(a[:2], 16) - int(b[:2], 16))
    ratios = abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16))
    return min(MOST, body + (length if length <= 1 else 12 * (length - 1)) + 4 * ratios)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 at the bounded difference."""
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by bucket, in order, each bucket ending with the first document of the next bucket."""
    waiting: tuple[int, int | None, str, str] | None = None  # bucket, id, text, digest
    for batch in batches:
        out: list[tuple] = []
        for bucket, ahead, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "ahead", "doc_id", "text")), strict=True):
            own = fingerprint(text.encode())
            if waiting and waiting[0] == bucket:
                _, known, before, digest = waiting
                changed = edited(before, text).encode()
                other = fingerprint(changed)
                out.append((known, len(before), hashlib.sha256(changed).hexdigest(), digest, other, likeness(digest, other), likeness(digest, own)))
            waiting = None if ahead else (bucket, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT) if out else pa.RecordBatch.from_pylist([], _RESULT)


def _borders(rows: DataFrame, n: int) -> np.ndarray:
    """At most n - 1 borders (key, tie) of ranges of rows, from a hashed sample of about SAMPLE rows a range."""
    whole = rows.count()
    every = max(1, whole // (SAMPLE * n))
    sample = rows.select("key", "tie").where(F.pmod(F.xxhash64("tie", "key"), F.lit(every)) == 0).toPandas()
    found = np.unique(np.rec.fromarrays([sample["key"].to_numpy(np.int64), sample["tie"].to_numpy(np.int64)], dtype=_ORDER))
    return found[np.unique(np.arange(1, n) * len(found) // n)] if len(found) else found


def _placed(held):
    """UDF of (key, tie) to the number of its range, by binary search in the borders."""

    def run(key: pd.Series, tie: pd.Series) -> pd.Series:
        rows = np.rec.fromarrays([key.to_numpy(np.int64), tie.to_numpy(np.int64)], dtype=_ORDER)
        return pd.Series(np.searchsorted(held.value, rows, "right"))

    return F.pandas_udf(run, "int")


def fingerprint_chain(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every document and of its text edited with the next document's.

    Documents are dealt into ranges of doc_id whose borders come from a bounded sample; the first document of every
    range is also sent to the range before it, so no task needs more than its range and the text moves once. A null
    doc_id comes before all others; rows that share a doc_id follow each other in the order of a hash of their texts, and a range may end
    between them.
    """
    spark = docs.sparkSession
    n = buckets or 4 * partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    borders = spark.sparkContext.broadcast(_borders(rows, n))
    rows = rows.withColumn("bucket", _placed(borders)("key", "tie"))
    # the first document of each range goes to the range before, that of the first to the last; of equal ones any, as its text is the same
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).select("bucket", "first.*")
    to = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    before = firsts.select(to.alias("to"), "key", "tie")
    ends = rows.join(F.broadcast(before), ["key", "tie"]).groupBy("to", "key", "tie").agg(F.first("text").alias("text"))
    ends = ends.select(F.col("to").alias("bucket"), F.lit(1).alias("ahead"), F.lit(None).cast("long").alias("doc_id"), "key", "tie", "text")
    dealt = rows.select("bucket", F.lit(0).alias("ahead"), "doc_id", "key", "tie", "text").unionByName(ends).repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "ahead", "key", "tie", "text")
    return dealt.select("bucket", "ahead", "doc_id", "text").mapInArrow(_walk, _RESULT_DDL)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: the fingerprint chain over all documents."""
    return fingerprint_chain(read(spark, sf_dir, "documents"))

