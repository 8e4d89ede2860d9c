"""Approximate nearest neighbours by additive quantisation.

Every vector, at unit length, is written as a sum of one full-dimensional entry from each of several codebooks, which
are fitted to residuals on a bounded sample. Encoding is a beam search over the codebooks with the residual norms; the
sum's squared norm and its distance from the vector are stored beside the codes. A query's table of products with all entries then scores
a code by a few look-ups. The exact cosines of the best codes of every part of the table give a bound, and every candidate whose score
plus its distance reaches that bound is ranked by exact cosines on the original vectors: no neighbour is lost to the codes.

Queries come in blocks of bounded size, each met with all candidates where these lie; no pair is shuffled but the few
nearest of each part. Defined results: vectors that are null, zero, hold null or non-finite components, or don't have the
most common length (the larger of equally common ones) take no part; equal scores go to the smaller vec_id; a repeated vec_id is
a candidate once for each distinct row and never of its own query; a query without candidates has no row; an empty table has an empty
result; of the table's columns only vec_id and embedding are read, so others may have any name. Results don't depend on how the table is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfield.llm.common import partitions, read, staged

#: Codebooks, their entries, the beam's width.
BOOKS, ENTRIES, BEAM = 8, 64, 4
#: Vectors the codebooks are fitted on, at most.
FIT = 8_192
#: Queries broadcast at once, at most.
BLOCK = 4_096
#: Of each query, candidates of a chunk whose exact cosines give the bound for all others.
AGAIN = 64
#: More than the rounding errors of scores and cosines.
SLACK = 1e-9
#: Candidates of a chunk.
CHUNK = 4_096


@dataclass
class Codebooks:
    """entries: (books, entries, dimensions)."""

    entries: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) of unit vectors and the squared norms of what they stand for."""
        n, rows = len(x), np.arange(len(x))[:, None]
        residual, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.entries:
            cost = (residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            parent, entry = best // len(book), best % len(book)
            residual = residual[rows, parent] - book[entry]
            codes = np.concatenate([codes[rows, parent], entry[:, :, None].astype(np.uint8)], 2)
        best = (residual**2).sum(2).argmin(1)
        codes, residual = codes[np.arange(n), best], residual[np.arange(n), best]
        return codes, ((x - residual) ** 2).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of entries that codes stand for."""
        out = np.zeros((len(codes), self.entries.shape[2]))
        for book, code in zip(self.entries, codes.T, strict=True):
            out += book[code]
        return out


def fit_codebooks(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Residual k-means, book by book, then two rounds of least-squares updates of all entries for the found codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    entries = max(1, min(entries, len(x)))
    residual, found = x.copy(), []
    for _ in range(books):
        book = residual[rng.choice(len(x), entries, replace=False)].copy()
        for _ in range(rounds):
            near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
            for e in range(entries):
                if (mine := near == e).any():
                    book[e] = residual[mine].mean(0)
        near = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
        residual -= book[near]
        found.append(book)
    model = Codebooks(np.stack(found))
    for _ in range(2):
        codes, _ = model.encode(x)
        design = np.zeros((len(x), books * entries), np.float32)
        design[np.arange(len(x))[:, None], np.arange(books) * entries + codes] = 1
        gram = design.T @ design + 1e-2 * np.eye(books * entries, dtype=np.float32)
        right = design.T @ x + 1e-2 * model.entries.reshape(books * entries, -1)
        model = Codebooks(np.linalg.solve(gram, right).reshape(books, entries, -1).astype(np.float32))
    return model


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common.n if common else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _encode(model, dim: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _unit(_matrix(part.column("v"), dim))
                codes, norms = model.value.encode(x, beam)
                off = np.sqrt(((x - model.value.decode(codes)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64)), pa.array(off)], ["vec_id", "v", "code", "norm", "off"])

    return run


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, off: np.ndarray, entries: np.ndarray, k: int, again: int) -> Iterator[tuple]:
    """Look-up scores of every query and candidate, then the k nearest by exact cosines of all that can be among them; ids ascend."""
    unit, mine, lengths = _unit(q), _unit(x), np.sqrt((x * x).sum(1))
    inverse = 1 / np.sqrt(np.maximum(norms, 1e-12))
    again = min(max(again, k), len(x))
    for at in range(0, len(q), 64):
        u, own = unit[at : at + 64], ids == q_ids[at : at + 64, None]
        scores = np.zeros((len(u), len(x)))
        for book, code in zip(entries.astype(float), codes.T, strict=True):
            scores += (u @ book.T)[:, code]
        first = np.argpartition(np.where(own, -np.inf, scores * inverse), len(x) - again, 1)[:, len(x) - again :]
        cosines = np.where(np.take_along_axis(own, first, 1), -np.inf, (mine[first] * u[:, None]).sum(2))
        reach = np.partition(cosines, again - k, 1)[:, again - k] if again >= k else np.full(len(u), -np.inf)
        can = (scores + off >= reach[:, None] - SLACK) & ~own
        some = np.flatnonzero(can.any(0))
        cosines = np.where(can[:, some], u @ mine[some].T, -np.inf)
        if len(some) > k:
            reach = np.maximum(reach, np.partition(cosines, len(some) - k, 1)[:, len(some) - k])
        for row, least, qid, qv in zip(cosines, reach, q_ids[at : at + 64], q[at : at + 64], strict=True):
            near = some[(row >= least - SLACK) & (row > -np.inf)]
            if len(near):
                # each pair on its own, so that equal vectors get equal scores
                exact = (x[near] * qv).sum(1) / (lengths[near] * np.sqrt((qv * qv).sum()))
                order = np.lexsort((ids[near], -exact))[:k]
                yield from ((int(qid), int(i), float(s)) for i, s in zip(ids[near][order], exact[order], strict=True))


def _search(model, block, dim: int, k: int, again: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        q_ids, q = block.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, x = part.column("vec_id").to_numpy(zero_copy_only=False), _matrix(part.column("v"), dim)
                order = np.argsort(ids, kind="stable")
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                norms, off = (part.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "off"))
                rows = list(_best(q_ids, q, ids[order], x[order], codes[order], norms[order], off[order], model.value.entries, k, again))
                found = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())
                yield pa.RecordBatch.from_arrays([*found], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, again: int = AGAIN, block: int = BLOCK, fit: int = FIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row whose vec_id divides by `every`, against all rows."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = usable(vectors)
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(fit).toPandas()["v"]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return none
    dim = len(sample.iloc[0])
    x = _unit(np.stack([np.asarray(v, float) for v in sample]))
    model = sc.broadcast(fit_codebooks(x))
    index = staged(rows.repartition(partitions(spark)).mapInArrow(_encode(model, dim, BEAM), "vec_id long, v array<double>, code binary, norm double, off double"), "index")
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    blocks = max(1, -(-queries.count() * 5 // (4 * block)))
    found = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        if not len(mine):
            continue
        held = sc.broadcast((mine["vec_id"].to_numpy(), np.stack([np.asarray(v, float) for v in mine["v"]])))
        near = index.mapInArrow(_search(model, held, dim, k, again), "query_id long, vec_id long, score double")
        near = near if blocks == 1 else staged(near, "near")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return none
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """Query: the five nearest of every fiftieth vector among all vectors."""
    return nearest(read(spark, sf_dir, "embeddings"))
