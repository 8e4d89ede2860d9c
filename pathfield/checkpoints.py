"""Where intermediate tables go: a folder of the application in the one that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Folders of the runs that are open, by application.
_runs: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: the application's, or its open run's, in what spark.checkpoint.dir names.

    Where the setting is absent, a session on one machine gets a temporary folder; a cluster's has to be set.
    """
    app = spark.sparkContext.applicationId
    if _runs.get(app):
        return _runs[app][-1]
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/staged-{app}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of executors, and makes sure that several readers
    of df see the same rows without computing them again. The files stay until `drop_staged`, or the end of a `staging` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(path: str) -> None:
    system, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    system.delete_dir(inner) if system.get_file_info(inner).type == fs.FileType.Directory else None


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application, or its open `staging` block, has staged. DataFrames that still read them fail from then on."""
    path = shared_dir(spark)
    _drop(path)
    app = spark.sparkContext.applicationId
    if _own_dirs.get(app) == path:
        del _own_dirs[app]


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A block whose staged tables are removed at its end; results have to be written or collected inside. Blocks may lie in each other."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    runs = _runs.setdefault(spark.sparkContext.applicationId, [])
    runs.append(path)
    try:
        yield path
    finally:
        runs.remove(path)
        _drop(path)
