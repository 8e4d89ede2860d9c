"""Operators on small made-up frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfield.functions import scalars
from pathfield.operators import detect, fit, groups, lag, linking, orient, sequence, shells, simulate, spatial
from pathfield.sources import files


def test_fill_gaps(spark):
    d = spark.createDataFrame([(1, 0, 9.0), (1, 1, 2.0), (1, 4, 5.0), (1, 7, 0.0)], "t int, f int, x double")
    got = [(r.f, r.x) for r in sequence.densify(d).orderBy("f").collect()]
    assert got == [(0, 9.0), (1, 2.0), (2, None), (3, None), (4, 5.0), (5, None), (6, None), (7, 0.0)]
    filled = [r.x for r in sequence.repair(d, ["x"]).orderBy("f").collect()]
    assert filled == pytest.approx([9, 2, 3, 4, 5, 10 / 3, 5 / 3, 0])
    assert sequence.densify(d, drop_over=1).count() == 0


def test_link_seven(spark):
    d = [(1, 1, 1), (1, 10, 20), (1, 50, 50), (2, 2, 2), (2, 11, 21), (2, 100, 100), (3, 100, 99)]
    dots = spark.createDataFrame([(i, f, float(x), float(y)) for i, (f, x, y) in enumerate(d)], "id long, f int, x double, y double")
    tracks = {}
    for r in linking.track_labels(dots, 10.0, 10).collect():
        tracks.setdefault(r.t, set()).add(d[r.id][1:])
    assert sorted(map(sorted, tracks.values())) == [[(1, 1), (2, 2)], [(10, 20), (11, 21)], [(50, 50)], [(100, 99), (100, 100)]]
    assert {r.t for r in linking.track_labels(dots, 10.0, 10, stub=2).where("id = 2").collect()} == {-1}


def test_cut_dot_starts_no_track(spark):
    dots = spark.createDataFrame([(0, 1, 0.0, 0.0, True), (1, 2, 0.5, 0.0, False)], "id long, f int, x double, y double, cut boolean")
    assert {r.id: r.t for r in linking.track_labels(dots, 5.0, 3, "cut").collect()} == {0: -1, 1: 0}


def test_msd_is_brute_force(spark):
    rng = np.random.default_rng(1)
    r = rng.uniform(-0.5, 0.5, (40, 2)).cumsum(0)
    o = rng.uniform(-3, 3, 40).cumsum()
    d = spark.createDataFrame([(0, f, *map(float, p), float(a)) for f, (p, a) in enumerate(zip(r, o, strict=True))], "t int, f int, x double, y double, o double")
    got = {x.tau: x.msd for x in lag.msd(d).collect()}
    for tau in range(40):
        assert got[tau] == pytest.approx(((r[tau:] - r[: 40 - tau]) ** 2).sum(1).mean())
    for x in lag.msd_body(d).collect():
        assert x.prog + x["div"] == pytest.approx(got[x.tau])


def test_all_lags_of_a_long_track(spark):
    rng = np.random.default_rng(2)
    n = 1_300
    f = np.delete(np.arange(n), [3, 700])  # with gaps
    r, o = rng.uniform(-0.5, 0.5, (n, 2)).cumsum(0), rng.uniform(-0.3, 0.3, n).cumsum()
    d = spark.createDataFrame([(t, int(i), *map(float, r[i]), float(o[i])) for t in (0, 5) for i in f] + [(7, 2, 1.0, 2.0, 3.0)], "t int, f int, x double, y double, o double")
    there = np.isin(np.arange(n), f)

    def mean(tau, value):
        i = np.arange(max(0, -tau), n - max(0, tau))
        i = i[there[i] & there[i + tau]]
        return value(i, i + tau).mean()

    step = lambda i, j: ((r[j] - r[i]) ** 2).sum(1)
    got = {x.tau: x.msd for x in lag.msd(d).where("t = 5").collect()}
    assert set(got) == set(range(n)) and all(got[k] == pytest.approx(mean(k, step)) for k in range(n))
    assert {x.tau: x.n for x in lag.msd_ensemble(d, 2).collect()} == {k: 2 + (k == 0) for k in range(n)}
    got = {x.tau: x["mean"] for x in lag.nn_corr(d, least=1).where("tau > 0").collect()}
    assert len(got) == n - 1 and all(got[k] == pytest.approx(mean(k, lambda i, j: np.cos(o[j] - o[i]))) for k in range(1, n))
    got = {x.tau: x["mean"] for x in lag.rn_corr(d, least=2).where("tau <> 0").collect()}
    along = lambda i, j: (r[j, 0] - r[i, 0]) * np.cos(o[i]) + (r[j, 1] - r[i, 1]) * np.sin(o[i])
    assert len(got) == 2 * n - 2 and all(got[k] == pytest.approx(mean(k, along)) for k in got)
    assert {x.tau for x in lag.angular_msd(d).where("t = 0").collect()} == {x.tau for x in lag.msd_body(d).where("t = 0").collect()} == set(range(n))


def test_unwrap_then_wrap(spark):
    o = np.linspace(0, 20, 50)
    d = spark.createDataFrame([(0, i, float((x + math.pi) % (2 * math.pi) - math.pi) if i != 7 else None) for i, x in enumerate(o)], "t int, f int, o double")
    got = [r.o for r in sequence.unwrap(d).orderBy("f").collect()]
    assert got[7] is None
    assert [g for i, g in enumerate(got) if i != 7] == pytest.approx([x for i, x in enumerate(o) if i != 7])


def test_dedupe_ties(spark):
    d = spark.createDataFrame([(0, 0, 1, 0.0, 0.0), (0, 1, 2, 1.0, 0.0), (0, 1, 3, 9.0, 0.0), (0, 2, 4, 2.0, 0.0), (1, 0, 5, 1.0, 1.0), (1, 0, 6, 1.0, 1.0)], "t int, f int, id long, x double, y double")
    assert sorted(r.id for r in sequence.dedupe(d).collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in sequence.dedupe(d, "keep").collect()) == [1, 2, 4, 5, 6]


def test_gauss_derivative_of_line(spark):
    d = spark.range(20).select(F.lit(0).alias("t"), F.col("id").cast("int").alias("f"), (F.col("id") * 3.0).alias("x"))
    got = [r.v for r in d.select("f", sequence.gauss_filter("x").alias("v")).orderBy("f").collect()]
    k = np.arange(-3, 4)
    w = np.exp(-(k**2) / (2 * 0.65**2))
    assert got[5:15] == pytest.approx([3 * (w / w.sum() * k * k).sum() / 0.65**2] * 10)


def test_square_lattice(spark):
    a = 0.1
    d = spark.createDataFrame([(0, 9 * i + j, i * math.cos(a) - j * math.sin(a), i * math.sin(a) + j * math.cos(a), a) for i in range(9) for j in range(9)], "f int, id long, x double, y double, o double")
    sh = {r.id: r.sh for r in shells.assign_shells(d, 9).collect()}
    assert sh == {9 * i + j: max(abs(i - 4), abs(j - 4)) for i in range(9) for j in range(9)}
    psi = {r.id: r.psi for r in spatial.psi_local(spatial.knn(d, 4)).collect()}
    assert all(psi[9 * i + j] == pytest.approx(1) for i in range(1, 8) for j in range(1, 8))
    near = {(r.id1, r.id2) for r in spatial.close_pairs(d, 1.5).collect()}
    assert near == {(r.id1, r.id2) for r in spatial.pairs(d, ordered=True).where("d < 1.5").collect()}
    assert shells.ring_valency(d).groupBy("ring").count().where("ring <= 3").orderBy("ring").toPandas()["count"].tolist() == [1, 8, 16]


def test_corners(spark):
    dots = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 50.0, 50.0)], "f int, id long, x double, y double")
    corners = spark.createDataFrame([(0, 1, 0.0, 10.0), (0, 2, 10.0, 0.0), (0, 3, 12.5, 0.0)], "f int, id long, x double, y double")
    got = {r.id: r.orient for r in orient.match_corners(dots, corners, 10.0).collect()}
    assert got[1] == pytest.approx(math.pi / 4) and got[2] is None


def test_walker_parameters_come_back(spark):
    d = simulate.walkers(spark, 150, 150, 1 / 21, 0.01, 0.3678)
    c = lag.nn_corr(d, 40).withColumn("dataset", F.lit("s"))
    (got,) = fit.fit(c, "nn", "dataset", "tau", "mean", "stderr", {"dr": 0.2}).collect()
    assert got.value == pytest.approx(1 / 21, rel=0.1)


def test_moment_tests(spark):
    d = spark.createDataFrame([(20.0, 0.5, -0.7)], "n double, s double, k double")
    r = d.select(groups.skew_test(F.col("n"), F.col("s")).alias("s"), groups.kurtosis_test(F.col("n"), F.col("k")).alias("k")).first()
    assert 0.9 < r.s < 1.2 and -1.2 < r.k < 0


def test_merge_and_scalars(spark):
    a, b = (spark.createDataFrame([(0, 1), (2, 2), (-1, 3)], "t long, id long") for _ in range(2))
    assert sorted(r.t for r in groups.merge([a, b]).collect()) == [-1, -1, 0, 2, 3, 5]
    r = spark.range(1).select(scalars.circle_through(*map(F.lit, (1.0, 0.0, 0.0, 1.0, -1.0, 0.0))).alias("c"), scalars.decade(F.lit(0.02)).alias("d"), scalars.dtheta(F.lit(3.0), F.lit(-3.0)).alias("a")).first()
    assert (r.c.x, r.c.y, r.c.r) == pytest.approx((0, 0, 1)) and r.d == pytest.approx(0.01) and r.a == pytest.approx(2 * math.pi - 6)


def test_detect_two_disks(spark):
    px = [(0, r, c, 1.0 if min((r - 8) ** 2 + (c - 8) ** 2, (r - 20) ** 2 + (c - 22) ** 2) <= 9 else 0.0) for r in range(30) for c in range(30)]
    pixels = spark.createDataFrame(px, "f int, r int, c int, v double")
    got = detect.segments(detect.label(detect.convolve(pixels, detect.disk_kernel(1.0, 2.0)), 2.0), 3, 100, 0.9).orderBy("x").collect()
    assert [(round(g.x), round(g.y)) for g in got] == [(8, 8), (22, 20)]


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# f x y lab ecc area\n     0   1.500   2.500    1 0.100    30\n     1   1.0   2.0    2 0.2    31\n")
    d = files.read_positions_text(spark, str(tmp_path / "p.txt"))
    assert [(r.f, r.x, r.id) for r in d.orderBy("id").collect()] == [(0, 1.5, 0), (1, 1.0, 1)]
    files.write_positions_text(d, str(tmp_path / "out"))
    assert files.read_positions_text(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "m_META.txt").write_text("'fps'             : 120\n'path'            : 'a:b'\n'none'            : None\n")
    meta = files.read_meta(spark, str(tmp_path / "m_META.txt"))
    assert {r.key: r.value for r in meta.collect()} == {"fps": "120", "path": "a:b", "none": None}
    assert files.meta_table(meta, ["fps"]).first().fps == "120"


def test_empty_and_nulls(spark):
    d = spark.createDataFrame([], "t int, f int, id long, x double, y double, o double")
    for out in (lag.msd(d), sequence.repair(d, ["x"]), sequence.unwrap(d), spatial.knn(d, 3), linking.parents(d), groups.length_filter(d)):
        assert out.count() == 0
