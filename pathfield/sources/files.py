"""Readers and writers of dots, metadata and oscilloscope files. Paths are whatever Spark's readers open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfield.checkpoints import staged
from pathfield.functions.scalars import parse_value, typed_value
from pathfield.schema import FITS


def read_positions_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated f x y lab ecc area, gzip or not, with header lines; id numbers the lines of each file from 0."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("file", "at", parts.alias("p")).where((F.size("p") >= 6) & F.col("p")[0].rlike(r"^[0-9]+$"))
    names = (("f", "int"), ("x", "double"), ("y", "double"), ("lab", "int"), ("ecc", "double"), ("area", "int"))
    row = (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("long")
    return rows.select(*[F.col("p")[i].cast(t).alias(n) for i, (n, t) in enumerate(names)], row.alias("id"))


def write_positions_text(dots: DataFrame, path: str) -> None:
    """One fixed-width line a dot."""
    dots.select(F.format_string("%6d %7.3f %7.3f %4d %1.3f %5d", "f", "x", "y", "lab", "ecc", "area").alias("value")).write.text(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(source, key, value) of files with a `key: value` line for every entry."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.split("value", ":", 2).alias("p")).where(F.size("p") == 2)
    return lines.select("source", parse_value(F.trim(F.col("p")[0])).alias("key"), parse_value(F.trim(F.col("p")[1])).alias("value"))


def meta_table(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One row a source, one column a key, and the numbers before mv and hz in the source's name; -1 where the name has none."""
    name = F.lower(F.translate("source", "_,", "  "))
    number = lambda unit: F.coalesce(F.nullif(F.regexp_extract(name, rf"(\d+)\s*{unit}", 1), F.lit("")).try_cast("int"), F.lit(-1))
    return meta.groupBy("source").pivot("key", keys).agg(F.first("value")).withColumns({"mv": number("mv"), "hz": number("hz")})


def typed_meta(meta: DataFrame) -> DataFrame:
    """meta with typed, struct(int, float, bool, text): each value as the first kind it can be read as."""
    return meta.withColumn("typed", typed_value(F.col("value")))


def update_meta(meta: DataFrame, *more: DataFrame) -> DataFrame:
    """(source, key, value): later tables' values stand before earlier ones'."""
    rows = meta.withColumn("__k", F.lit(0))
    for k, m in enumerate(more, 1):
        rows = rows.unionByName(m.withColumn("__k", F.lit(k)))
    return rows.groupBy("source", "key").agg(F.max_by("value", "__k").alias("value"))


def edit_meta(meta: DataFrame, old: str, new: str | None = None, value=None, backup: str | None = None) -> DataFrame:
    """meta with a key renamed, or its value replaced by a text or a function of its Column; backup: the key under which the old value stays."""
    if new is None and value is None:
        raise ValueError("neither a new key nor a new value")
    mine = F.col("key") == old
    own = meta.where(mine)
    if new is not None and new != old:
        # an older entry under the new key gives way
        meta = meta.where(F.col("key") != new).unionByName(meta.where(F.col("key") == new).join(own.select("source"), "source", "left_anti"))
    changed = value(F.col("value")) if callable(value) else F.col("value") if value is None else F.lit(value)
    edited = meta.select("source", F.when(mine, new or old).otherwise(F.col("key")).alias("key"), F.when(mine, changed).otherwise(F.col("value")).alias("value"))
    return edited if backup is None else edited.unionByName(own.select("source", F.lit(backup).alias("key"), "value"))


def synced(args: dict, meta: dict, names: dict[str, str], defaults: dict | None = None) -> tuple[dict, dict]:
    """args and meta with each other's values: a given argument goes to its key in meta (names), a missing one comes from there, else from the defaults."""
    args, meta = dict(args), dict(meta)
    for a, m in names.items():
        if args.get(a) is None:
            args[a] = meta.get(m, (defaults or {}).get(a))
        else:
            meta[m] = args[a]
    return args, meta


def merge_meta(meta: DataFrame, conflicts: str | Callable[[Column], Column] = "null") -> DataFrame:
    """(key, value, values): the value all sources agree on, and all distinct values.

    conflicts: 'null' leaves the value of others empty, 'join' joins them by commas, 'fail' is an error when read; a function of the array
    of values gives the value itself.
    """
    g = meta.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    other = {"null": lambda v: F.lit(None), "join": lambda v: F.array_join(v, ", "), "fail": lambda v: F.raise_error(F.concat(F.lit("values differ: "), F.col("key")))}
    given = conflicts if callable(conflicts) else other[conflicts]
    return g.select("key", F.when(F.size("values") == 0, None).when(F.size("values") == 1, F.get("values", 0)).otherwise(given(F.col("values")).cast("string")).alias("value"), "values")


def write_meta(meta: DataFrame, path: str) -> None:
    meta.select(F.concat_ws(": ", F.rpad("key", 18, " "), "value").alias("value")).write.text(path)


def read_oscilloscope(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """(file, channel, t, v) of tab-separated files with six columns a channel, the last useful two being time and value.

    A file whose first line doesn't state its number of lines as Record Length is an error when read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("p"))
    heads = F.max(F.when(F.trim(F.get("p", 0)) == "Record Length", F.get("p", 1).try_cast("int")))
    files = lines.groupBy("file").agg(heads.alias("stated"), F.count(F.lit(1)).alias("lines"))
    whole = files.where(F.when(F.col("stated") == F.col("lines"), True).otherwise(F.raise_error(F.concat(F.lit("bad format in "), F.col("file"))))).select("file")
    pairs = F.array(*[F.struct(F.lit(k).alias("channel"), F.get("p", 6 * k + 3).try_cast("double").alias("t"), F.get("p", 6 * k + 4).try_cast("double").alias("v")) for k in range(channels)])
    return lines.join(whole, "file").select("file", F.explode(pairs).alias("s")).select("file", "s.*").where("t is not null and v is not null")


def read_oscilloscope_meta(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """(file, channel, key, value, unit) of the three columns that a channel begins with."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("p"))
    parts = F.array(*[F.struct(F.lit(k).alias("channel"), *[F.trim(F.get("p", 6 * k + i)).alias(n) for i, n in enumerate(("key", "value", "unit"))]) for k in range(channels)])
    return lines.select("file", F.explode(parts).alias("s")).select("file", "s.*").where("key <> ''")


def check_clipping(scope: DataFrame, offset: float, scale: float, most: float = 5.0) -> DataFrame:
    """scope; a value beyond the screen is an error when read."""
    inside = F.abs((F.col("v") - offset) / scale) < most
    return scope.where(F.when(inside, True).otherwise(F.raise_error(F.lit("clipped trace"))))


def gather_fits(fits: DataFrame, params: list[str]) -> DataFrame:
    """One row a dataset and function, one column a parameter."""
    return fits.groupBy("dataset", "func").pivot("param", params).agg(F.first("value"))


def merge_fits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old values but where new ones stand for the same dataset, function and parameter."""
    key = ["dataset", "func", "param"]
    return old.join(new, key, "left_anti").unionByName(new)


def load_fits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FITS).parquet(path)


def save_fits(new: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """Write fits, merged with old ones if given; these may be read from the same path, so the whole is staged first."""
    names = ["dataset", "func", "param", "value"]
    whole = new.select(*names) if old is None else merge_fits(old.select(*names), new.select(*names))
    staged(whole, "fits").write.mode("overwrite").parquet(path)
