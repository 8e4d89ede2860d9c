"""Datasets as folders of Parquet tables, and image folders as pixel tables. Paths are whatever Spark's readers open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.operators.detect import clip_scale, find_dots
from pathfield.operators.linking import dense_rank
from pathfield.schema import as_tracks

#: Tables of a dataset by the first letter they are asked for with.
TABLES = {"t": "tracks", "p": "positions", "o": "orientation", "c": "corner_positions", "m": "melt"}


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_dataset(spark: SparkSession, prefix: str, sets: str = "t") -> dict[str, DataFrame]:
    """Tables of the dataset in a folder, by name. Without tracks, positions stand for them as rows of track -1; without positions, the tracks' places.

    A table that is asked for and neither there nor to be had from another is an error.
    """
    out = {}
    for letter in dict.fromkeys(s[0].lower() for s in sets):
        name = TABLES[letter]
        found = _table(spark, f"{prefix}/{name}")
        if found is None and letter == "t" and (dots := _table(spark, f"{prefix}/positions")) is not None:
            found = as_tracks(dots)
        if found is None and letter == "p" and (tracks := _table(spark, f"{prefix}/tracks")) is not None:
            found = tracks.select("f", "x", "y", "id")
        if found is None:
            raise FileNotFoundError(f"{prefix} has no {name}")
        out[name] = found
    return out


def save_dataset(tables: dict[str, DataFrame], prefix: str, compression: str = "zstd") -> None:
    """Write tables under their names, in place of older ones."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", compression).parquet(f"{prefix}/{name}")


def load_msds(spark: SparkSession, prefix: str, linear: bool = True, angular: bool = True) -> DataFrame:
    """(t, tau, msd, msd_angular) of a dataset's tables msd and amsd. Where both are read, a track has to have the same lags in both."""
    a = spark.read.parquet(f"{prefix}/msd").select("t", "tau", "msd") if linear else None
    b = spark.read.parquet(f"{prefix}/amsd").select("t", "tau", F.col("msd").alias("msd_angular")) if angular else None
    if a is None or b is None:
        return b if a is None else a
    both = a.join(b, ["t", "tau"], "full")
    odd = F.raise_error(F.lit("linear and angular displacements have different lags"))
    return both.where(F.when(F.col("msd").isNull() | F.col("msd_angular").isNull(), odd).otherwise(True))


def find_datasets(spark: SparkSession, root: str, ending: str = "_LOG.txt") -> DataFrame:
    """(prefix) of every file below a folder whose name ends so, without the ending. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(root)
    return files.select(F.expr(f"left(path, length(path) - {len(ending)})").alias("prefix"))


def read_images(spark: SparkSession, path: str, glob: str = "*.tif", frames: slice = slice(None)) -> DataFrame:
    """(f, path, content): images numbered in the order of their paths, those of a slice of the numbers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    number = dense_rank(files.select("path"), "path").withColumnRenamed("rank", "f")
    start, step = frames.start or 0, frames.step or 1
    kept = number.where((F.col("f") >= start) & ((F.col("f") - start) % step == 0))
    if frames.stop is not None:
        kept = kept.where(F.col("f") < frames.stop)
    return kept.join(files.select("path", "content"), "path").select(F.col("f").cast("int").alias("f"), "path", "content")


def decode(content: bytes) -> np.ndarray:
    """Rows and columns of an image: binary PGM or PPM (the green channel), or TIFF of whole numbers or floats without compression."""
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            end = at
            while content[end : end + 1].isspace():
                end += 1
            if content[end : end + 1] == b"#":
                at = content.index(b"\n", end)
                continue
            at = end
            while not content[at : at + 1].isspace():
                at += 1
            fields.append(int(content[end:at]))
        width, height, top = fields
        channels = 3 if content[:2] == b"P6" else 1
        data = np.frombuffer(content, ">u2" if top > 255 else "u1", width * height * channels, at + 1).reshape(height, width, channels)
        return data[:, :, 1 if channels == 3 else 0].astype(float)
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or np.frombuffer(content, order + "u2", 1, 2)[0] != 42:
        raise ValueError("neither PGM, PPM nor TIFF")
    at = int(np.frombuffer(content, order + "u4", 1, 4)[0])
    tags = {}
    for k in range(int(np.frombuffer(content, order + "u2", 1, at)[0])):
        entry = at + 2 + 12 * k
        tag, kind = (int(v) for v in np.frombuffer(content, order + "u2", 2, entry))
        n = int(np.frombuffer(content, order + "u4", 1, entry + 4)[0])
        size = {1: "u1", 3: "u2", 4: "u4"}.get(kind)
        if size:
            there = entry + 8 if n * int(size[1]) <= 4 else int(np.frombuffer(content, order + "u4", 1, entry + 8)[0])
            tags[tag] = [int(v) for v in np.frombuffer(content, order + size, n, there)]
    if tags.get(259, [1]) != [1]:
        raise ValueError("compressed TIFF")
    width, height, channels, bits = tags[256][0], tags[257][0], tags.get(277, [1])[0], tags.get(258, [1])[0]
    kind = order + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(bits // 8)
    data = np.concatenate([np.frombuffer(content, "u1", n, o) for o, n in zip(tags[273], tags[279], strict=True)])
    return data.view(kind).reshape(height, width, channels)[:, :, 1 if channels > 1 else 0].astype(float)


def pixels(images: DataFrame, at_once: int = 1 << 18) -> DataFrame:
    """(f, r, c, v) of decoded images: each is decoded where its file was read and handed on in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, content in zip(batch["f"], batch["content"], strict=True):
                image = decode(content)
                flat, width = image.ravel(), image.shape[1]
                for at in range(0, len(flat), at_once):
                    k = np.arange(at, min(at + at_once, len(flat)))
                    yield pd.DataFrame({"f": np.full(len(k), f, np.int32), "r": (k // width).astype(np.int32), "c": (k % width).astype(np.int32), "v": flat[k]})

    return images.select("f", "content").mapInPandas(run, "f int, r int, c int, v double")


def detect_images(spark: SparkSession, path: str, kernel: float, glob: str = "*.tif", frames: slice = slice(None), width: float = 2.0, **kept) -> DataFrame:
    """Positions of the dots of a folder of images: decode, clip and scale, find dots; ids count the dots by frame and label."""
    scaled = staged(clip_scale(pixels(read_images(spark, path, glob, frames)), width), "images")
    found = staged(find_dots(scaled, kernel, **kept), "found")
    ids = dense_rank(found.select("lab"), "lab").withColumnRenamed("rank", "id")
    return found.join(ids, "lab").select("f", "x", "y", "lab", "ecc", "area", "id")
