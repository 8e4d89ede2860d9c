"""Images in archives against a folder of the same images."""

import io
import tarfile

import numpy as np
import pytest

from pathfield.sources import datasets
from pathfield.sources.archives import read_archive


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    base = tmp_path_factory.mktemp("images")
    (base / "dir").mkdir()
    rng = np.random.default_rng(1)
    files = {}
    for k in rng.permutation(12):
        v = rng.integers(0, 256, (5, 7 + k % 2), dtype=np.uint8)
        files[f"im{k:03}.pgm"] = b"P5\n%d %d\n255\n" % v.shape[::-1] + v.tobytes()
    for name, data in files.items():
        (base / "dir" / name).write_bytes(data)
    for kind, mode in (("tar", "w"), ("tgz", "w:gz")):
        with tarfile.open(base / f"a.{kind}", mode) as tar:
            for name, data in [*files.items(), ("notes.txt", b"x")]:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return base


def rows(df):
    return sorted(map(tuple, datasets.pixels(df).collect()))


@pytest.mark.parametrize("kind", ["tar", "tgz"])
@pytest.mark.parametrize("frames", [slice(None), slice(2, 9, 3), slice(-4, None)])
def test_archive_equals_folder(spark, images, kind, frames):
    got = read_archive(spark, str(images / f"a.{kind}"), "*.pgm", frames, task_bytes=120)
    kept = range(12)[frames]
    want = datasets.read_images(spark, str(images / "dir"), "*.pgm").where(f"f in ({', '.join(map(str, kept))})")
    assert rows(got) == rows(want) and got.count() == len(kept)


def test_tasks_and_size_stop(spark, images):
    size = len((images / "dir" / "im000.pgm").read_bytes())
    many = read_archive(spark, str(images / "a.tar"), "*.pgm", task_bytes=2 * size + 10)
    assert many.rdd.getNumPartitions() >= 6
    few = read_archive(spark, str(images / "a.tar"), "*.pgm", most_bytes=5 * size)
    assert 3 < few.count() <= 5
    assert read_archive(spark, str(images / "a.tar"), "*.none").count() == 0
