"""Images in tar archives as a Spark data source: partitions are byte ranges of an archive's members, so an archive is read by many tasks.

The driver reads the members' headers alone. A compressed archive can't be entered in the middle: it is one partition, read as a stream.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that a task reads.
TASK = 64 << 20


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass
class Members(InputPartition):
    """Members of an archive: (number, name, offset, size) each; an offset below 0 stands for a stream."""

    archive: str
    members: list[tuple[int, str, int, int]]


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        # Spark hands on options in lower case
        options = {k.lower(): v for k, v in options.items()}
        self.paths = [p for p in options["path"].split(",") if p]
        self.glob = options.get("glob", "*.tif")
        self.start, self.stop, self.step = (int(options[k]) if options.get(k) else None for k in ("start", "stop", "step"))
        self.most = float(options.get("maxbytes") or "inf")
        self.task = int(options.get("taskbytes") or TASK)

    def partitions(self) -> list[Members]:
        found = []
        for path in self.paths:
            with _opened(path) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:
                plain = tar.fileobj is raw
                found += [(m.name, path, m.offset_data if plain else -1, m.size) for m in tar if m.isfile() and fnmatch(m.name, self.glob)]
        found.sort()
        out, held, total = [], {}, 0
        for number in range(len(found))[slice(self.start, self.stop, self.step)]:
            name, path, offset, size = found[number]
            total += size
            if total > self.most:
                break
            part = held.get(path)
            if part is None or offset >= 0 and sum(m[3] for m in part.members) + size > self.task:
                part = held[path] = Members(path, [])
                out.append(part)
            part.members.append((number, name, offset, size))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple[int, str, bytes]]:
        if not partition.members:
            return
        with _opened(partition.archive) as raw:
            if partition.members[0][2] >= 0:
                for number, name, offset, size in partition.members:
                    raw.seek(offset)
                    yield number, name, raw.read(size)
                return
            wanted = {name: number for number, name, *_ in partition.members}
            with tarfile.open(fileobj=raw, mode="r|*") as tar:
                for m in tar:
                    if m.name in wanted:
                        yield wanted[m.name], m.name, tar.extractfile(m).read()


class TarImages(DataSource):
    """format("tar_images"): (f, path, content) of an archive's members, numbered by name. Options: glob, start, stop, step (a slice of the numbers), maxBytes (images from the one that exceeds it on are left out), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "tar_images"

    def schema(self) -> str:
        return "f int, path string, content binary"

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, glob: str = "*.tif", frames: slice = slice(None), most_bytes: int | None = None, task_bytes: int = TASK) -> DataFrame:
    """(f, path, content) of the images in a tar archive, as datasets.read_images has them of a folder: numbered by name, those of a slice of the numbers, until most_bytes are reached."""
    spark.dataSource.register(TarImages)
    options = {"glob": glob, "start": frames.start, "stop": frames.stop, "step": frames.step, "maxBytes": most_bytes, "taskBytes": task_bytes}
    return spark.read.format("tar_images").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)
