"""Linking on a stream against the batch operator."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from pathfield.operators import linking
from pathfield.streaming.linking import stream_parents


def test_stream_gives_the_parents_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for f in range(14):
        for k in range(9):
            if rng.random() < 0.8:
                rows.append((i, f, float(40 * k + 3 * f + rng.normal()), float(10 * np.sin(f / 3 + k) + rng.normal())))
                i += 1
    dots = spark.createDataFrame(rows, "id long, f int, x double, y double")
    expected = {(r.id, r.parent) for r in linking.parents(dots, 12.0, 3).where("parent is not null").collect()}
    # frames arrive in files of three, out of order within the delay, and a last dot far ahead brings the watermark on
    folder = tmp_path / "in"
    os.makedirs(folder)
    late = sorted(rows, key=lambda r: r[1] + (2 * rng.random() if r[1] % 2 else 0))
    chunks = [late[k : k + 25] for k in range(0, len(late), 25)] + [[(10_000, 400, 1e6, 1e6)], [(10_001, 800, -1e6, 1e6)]]
    for k, part in enumerate(chunks):
        with open(folder / f"{k:03}.json", "w") as out:
            out.writelines(json.dumps({"ts": f"2024-01-01T00:{r[1] // 60:02}:{r[1] % 60:02}Z", "id": r[0], "x": r[2], "y": r[3]}) + "\n" for r in part)
        os.utime(folder / f"{k:03}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("ts timestamp, id long, x double, y double").option("maxFilesPerTrigger", 1).json(str(folder))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = stream_parents(stream, 12.0, 3, delay_frames=4).writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = {(r.id, r.parent) for r in spark.table("linked").where(F.col("id") < 10_000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected and len(got) > 60
