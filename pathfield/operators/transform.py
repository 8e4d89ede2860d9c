"""Sums of products over all lags of long series, by Fourier transforms dealt over the tasks.

sum over f of A(f + tau) B(f), for every tau at once, is the inverse transform of A's spectrum times the conjugate of B's, so the work grows as L log L. A series
of up to WHOLE frames is one group. A longer one is a matrix of N1 rows and N2 columns, N = N1 N2 >= 2 L, in row order, and takes three steps with two shuffles between them:
the columns' transforms and a turn; the rows' transforms, the products and the rows' inverse ones and a turn; the columns' inverse transforms. Columns and rows
come in bands of BAND, and what is shuffled are the tiles where bands meet; a group holds about BAND sqrt(2 L) numbers a channel, whatever the length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest series that is transformed in one group.
WHOLE = 1 << 15
BAND = 16

#: Output name to a sum of (factor, later channel, earlier channel).
Products = dict[str, list[tuple[float, str, str]]]


def lag_sums(series: DataFrame, channels: dict[str, Column], products: Products, two_sided: bool = False, t: str = "t", f: str = "f", whole: int = WHOLE, band: int = BAND) -> DataFrame:
    """(t, tau, products...): for each lag of a series up to its length the sums of products of channels, later times earlier; negative lags too if two_sided.

    A channel is 0 where it is NULL or a frame has no row; rows of one frame add up. whole, band: powers of two.
    """
    names, outs = list(channels), list(products)
    rows = series.where(F.col(t).isNotNull() & F.col(f).isNotNull())
    ends = rows.groupBy(t).agg(F.min(f).cast("long").alias("lo"), (F.max(f) - F.min(f) + 1).cast("long").alias("n"))
    summed = rows.groupBy(F.col(t), F.col(f).cast("long").alias("at")).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in channels.items()])
    placed = summed.join(ends, t).select(F.col(t).alias("key"), (F.col("at") - F.col("lo")).alias("at"), "n", *names)
    kind = dict(series.dtypes)[t]
    found = f"key {kind}, tau long, " + ", ".join(f"{o} double" for o in outs)
    short = placed.where(F.col("n") <= whole).groupBy("key").applyInPandas(_whole(names, products, two_sided), found)
    # N = 2^bits, of which the upper half of the bits count rows
    long = placed.where(F.col("n") > whole).withColumn("bits", F.length(F.bin(2 * F.col("n") - 1)).cast("int"))
    columns = F.expr("shiftleft(1L, cast(bits - bits div 2 as int))")
    tile = f"key {kind}, n long, bits int, row_band long, column_band long, data binary"
    first = long.withColumn("column_band", F.floor((F.col("at") % columns) / band)).groupBy("key", "column_band").applyInPandas(_columns(names, band), tile)
    second = first.groupBy("key", "row_band").applyInPandas(_rows(names, products, band), tile)
    third = second.groupBy("key", "column_band").applyInPandas(_back(outs, two_sided, band), found)
    return short.unionByName(third).select(F.col("key").alias(t), "tau", *outs)


def _spectra(x: np.ndarray, names: list[str], products: Products) -> np.ndarray:
    """The spectra of the outputs from those of the channels, which are along the first axis."""
    place = {k: i for i, k in enumerate(names)}
    return np.stack([sum(w * x[place[a]] * np.conj(x[place[b]]) for w, a, b in terms) for terms in products.values()])


def _frame(key, tau: np.ndarray, sums: np.ndarray, outs: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "tau": tau} | {o: sums[i] for i, o in enumerate(outs)})


def _whole(names: list[str], products: Products, two_sided: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        size = 1 << (2 * n - 1).bit_length()
        x = np.zeros((len(names), size))
        x[:, rows["at"].to_numpy()] = rows[names].to_numpy().T
        sums = np.fft.ifft(_spectra(np.fft.fft(x), names, products)).real
        tau = np.arange(-n + 1 if two_sided else 0, n)
        return _frame(rows["key"].iloc[0], tau, sums[:, tau], list(products))

    return run


def _turn(bits: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """exp(-2 pi i row column / N)."""
    return np.exp(-2j * np.pi / (1 << bits) * (rows[:, None] * columns[None, :] % (1 << bits)))


def _shape(rows: pd.DataFrame) -> tuple[int, int, int]:
    bits = int(rows["bits"].iloc[0])
    return bits, 1 << bits // 2, 1 << bits - bits // 2


def _columns(names: list[str], band: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits, n1, n2 = _shape(rows)
        b = int(rows["column_band"].iloc[0])
        at = rows["at"].to_numpy()
        x = np.zeros((len(names), n1, band))
        x[:, at // n2, at % n2 - b * band] = rows[names].to_numpy().T
        x = np.fft.fft(x, axis=1) * _turn(bits, np.arange(n1), b * band + np.arange(band))
        return _tiles(rows, [(r, b, x[:, r * band : (r + 1) * band]) for r in range(n1 // band)])

    return run


def _tiles(rows: pd.DataFrame, tiles: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    key, n, bits = (rows[c].iloc[0] for c in ("key", "n", "bits"))
    return pd.DataFrame([(key, n, bits, r, c, np.ascontiguousarray(x, np.complex128).tobytes()) for r, c, x in tiles], columns=["key", "n", "bits", "row_band", "column_band", "data"])


def _gathered(rows: pd.DataFrame, by: str, many: int, band: int, width: int, axis: int) -> np.ndarray:
    """A group's tiles side by side; a band in which the series has no frame is 0."""
    shape = (many, band, width) if axis == 2 else (many, width, band)
    x = np.zeros(shape, np.complex128)
    for b, data in zip(rows[by], rows["data"], strict=True):
        part = np.frombuffer(data, np.complex128).reshape(many, band, band)
        at = slice(int(b) * band, (int(b) + 1) * band)
        if axis == 2:
            x[:, :, at] = part
        else:
            x[:, at] = part
    return x


def _rows(names: list[str], products: Products, band: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits, _, n2 = _shape(rows)
        r = int(rows["row_band"].iloc[0])
        x = np.fft.fft(_gathered(rows, "column_band", len(names), band, n2, 2), axis=2)
        y = np.fft.ifft(_spectra(x, names, products), axis=2) * np.conj(_turn(bits, r * band + np.arange(band), np.arange(n2)))
        return _tiles(rows, [(r, c, y[:, :, c * band : (c + 1) * band]) for c in range(n2 // band)])

    return run


def _back(outs: list[str], two_sided: bool, band: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits, n1, n2 = _shape(rows)
        b, n = int(rows["column_band"].iloc[0]), int(rows["n"].iloc[0])
        sums = np.fft.ifft(_gathered(rows, "row_band", len(outs), band, n1, 1), axis=1).real
        tau = np.arange(n1)[:, None] * n2 + b * band + np.arange(band)[None, :]
        tau = np.where(tau >= 1 << bits - 1, tau - (1 << bits), tau)
        kept = (np.abs(tau) < n) & (two_sided | (tau >= 0))
        return _frame(rows["key"].iloc[0], tau[kept], sums[:, kept], outs)

    return run
