"""Track sets, datasets, images, fits, envelopes, metadata, and plans that stay linear."""

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfield.functions import scalars
from pathfield.operators import detect, fit, graph, groups, lag, linking, noise, sequence, shells, simulate, spatial, tracksets
from pathfield.sources import datasets, files

TRACK = "t long, f int, id long, x double, y double, o double"


def tracks(spark, rows):
    return spark.createDataFrame(rows, TRACK)


def test_track_sets(spark):
    rows = [(0, f, f, float(f), 0.0, (f * 1.5) % (2 * math.pi)) for f in (0, 1, 2, 5, 6)] + [(1, f, 10 + f, 0.0, 1.0, 0.0) for f in range(3)] + [(-1, 0, 99, 0.0, 0.0, 0.0)]
    d = tracks(spark, rows)
    of = lambda out: sorted((r.t, r.f, r.x) for r in out.collect())
    assert of(tracksets.tracksets(d, 4, gaps="interp")) == [(0, f, float(f)) for f in range(7)]
    assert of(tracksets.tracksets(d, -1, gaps="nans")) == [(0, f, None if f in (3, 4) else float(f)) for f in range(7)]
    assert of(tracksets.tracksets(d, 1, rows="1:3")) == [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 0.0), (1, 2, 0.0)]
    assert of(tracksets.tracksets(d, 1, rows="-2:")) == [(0, 5, 5.0), (0, 6, 6.0), (1, 1, 0.0), (1, 2, 0.0)]
    assert of(tracksets.tracksets(d, 1, rows="::-1").where("t = 0")) == [(0, 6 - f, float(f)) for f in (6, 5, 2, 1, 0)]
    assert of(tracksets.tracksets(d, 1, frames="1:4:2")) == [(0, 1, 1.0), (0, 5, 5.0), (1, 1, 0.0)]
    o = [r.o for r in tracksets.tracksets(d, 4, unwrap=True).orderBy("f").collect()]
    assert o[:3] == pytest.approx([0, 1.5, 3.0])
    with pytest.raises(ValueError):
        tracksets.tracksets(d, gaps="other")
    with pytest.raises(ValueError):
        tracksets.sliced(d, "::-2")
    assert tracksets.tracksets(d.limit(0)).count() == 0


def test_linear_windows_on_a_long_track(spark):
    n = 60_000
    d = spark.range(n).select(F.lit(0).alias("t"), F.col("id").cast("int").alias("f"), F.when(F.col("id") % 7 != 3, F.col("id") * 2.0).alias("x"))
    began = time.time()
    assert sequence.interpolate(d, ["x"]).where(F.abs(F.col("x") - F.col("f") * 2.0) < 1e-9).count() == n
    assert sequence.running_extrema_start(d.withColumn("x", F.col("f") * 1.0), "x", "t", "f").first().start == 0
    assert sequence.running_extrema_start(d.withColumn("x", F.col("f") * 1.0), "x", "t", "f", (5, 9)).first().start == 5
    assert time.time() - began < 60


def test_interpolation_at_the_ends(spark):
    d = spark.createDataFrame([(0, f, v) for f, v in enumerate([None, None, 1.0, None, 3.0, None])], "t int, f int, x double")
    assert [r.x for r in sequence.interpolate(d, ["x"], 2).orderBy("f").collect()] == [1.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    assert [r.x for r in sequence.interpolate(d, ["x"], 1).orderBy("f").collect()] == [None, None, 1.0, 2.0, 3.0, 3.0]


def test_onset_of_motion(spark):
    rows = [(t, f, 0, 0.01 * ((f * 7 + t) % 3) + max(0, f - 20) ** 2, 0.0, 0.0) for t in range(3) for f in range(60)] + [(0, 60, 0, 0.0, 0.0, 0.0)]
    got = sequence.motion_onset(tracks(spark, rows).withColumn("dataset", F.lit("a")), (5, None)).first()
    assert 18 <= got.start <= 22


def test_envelope(spark):
    rows = [(0, f, f, 3.0 + 0.5 * math.cos(2 * math.pi * f / 16), 0.0, 0.0) for f in range(256)]
    got = np.array([r.envelope for r in sequence.envelope(tracks(spark, rows), "x", 0).orderBy("f").collect()])
    assert got == pytest.approx(3.5, abs=1e-6)
    smooth = np.array([r.envelope for r in sequence.envelope(tracks(spark, rows), "x").orderBy("f").collect()])
    assert smooth[64:192] == pytest.approx(3.5, abs=0.05)


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(3)
    clumps = np.concatenate([rng.normal(c, 0.01, (40, 2)) for c in ((0, 0), (1, 1), (5, 0))] + [rng.random((60, 2)) * 9, [[4.0, 4.0]] * 3])
    rows = [(f, 1000 * f + i, float(x), float(y)) for f, p in enumerate((clumps, clumps[:3], clumps[:1], np.zeros((8, 2)))) for i, (x, y) in enumerate(p)]
    d = spark.createDataFrame(rows, "f int, id long, x double, y double")
    got = {}
    for r in spatial.knn(d, 4).collect():
        got.setdefault((r.f, r.id1), {})[r.rank] = r.id2
    by = {}
    for f, i, x, y in rows:
        by.setdefault(f, []).append((i, x, y))
    for f, members in by.items():
        for i, x, y in members:
            near = sorted((math.hypot(a - x, b - y), j) for j, a, b in members if j != i)[:4]
            assert [got.get((f, i), {}).get(k + 1) for k in range(len(near))] == [j for _, j in near]
    far = {r.f: r.d for r in spatial.diameter(d).collect()}
    for f, members in by.items():
        assert far[f] == pytest.approx(max(math.hypot(a[1] - b[1], a[2] - b[2]) for a in members for b in members))


def test_roots_and_components(spark):
    chain = [(i, i - 1 if i % 50 else None) for i in range(200)]
    got = {r.id: r.root for r in graph.roots(spark.createDataFrame(chain, "id long, parent long")).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}
    assert graph.roots(spark.createDataFrame([], "id long, parent long")).count() == 0
    keys = spark.range(500).select((F.col("id") * F.col("id")).alias("k"))
    ranks = {r.k: r["rank"] for r in linking.dense_rank(keys, "k").collect()}
    assert ranks == {k * k: k for k in range(500)}


def test_tau_grid():
    assert lag.tau_grid(10, 3) == [3, 6, 9] and lag.tau_grid(10, 3, most=2) == [3, 6]
    assert lag.tau_grid(20, 2.0) == [1, 2, 4, 8, 16]
    with pytest.raises(ValueError):
        lag.tau_grid(20, 0.5)


def test_fit_chain_recovers_the_walkers(spark):
    dr, v0, dt = 1 / 21, 0.3678, 0.01
    w = simulate.walkers(spark, 300, 150, dr, dt, v0)
    curve = lambda c, m, e: c.where("abs(tau) <= 60").select(F.lit("s").alias("dataset"), "tau", F.col(m).alias("mean"), F.col(e).alias("stderr"))
    nn, rn, rr = curve(lag.nn_corr(w, 60), "mean", "stderr"), curve(lag.rn_corr(w, max_lag=60), "mean", "stderr"), curve(lag.rr_stack(w, max_lag=60), "total", "total_err")
    got = {(r.func, r.param): r.value for r in fit.fit_chain(nn, rn, rr, dtheta=0.0, dx=0.0).collect()}
    assert got["nn", "dr"] == pytest.approx(dr, rel=0.1) and got["rn", "lp"] == pytest.approx(v0 / dr, rel=0.15) and 0 <= got["rr", "dt"] < 0.2
    both = {(r.func, r.param): r.value for r in fit.fit_chain(nn, rn, rr, mode="anti", dtheta=0.0, dx=0.0).collect()}
    assert both["ra", "lp"] == pytest.approx(got["rn", "lp"], rel=0.1)


def test_sigma_and_parameters(spark):
    c = spark.createDataFrame([(float(t), 2.0, 0.5) for t in range(6)], "tau double, mean double, stderr double")
    got = {r.tau: r.sigma for r in fit.sigma_for_fit(c, "tau", "mean", "stderr", 0.3, True, 1, [0, 4]).collect()}
    assert got == {float(t): pytest.approx(math.hypot(0.25, 0.3) * t) for t in range(1, 5)}
    fits = spark.createDataFrame([("a", "rn", "dr", 0.2), ("a", "nn", "dr", 0.1), ("b", "rn", "lp", 3.0)], "dataset string, func string, param string, value double")
    assert {(r.dataset, r.value, r.source) for r in fit.parameter(fits, "dr").collect()} == {("a", 0.1, "nn"), ("b", 1 / 16, "guess")}


def test_axis_and_peaks(spark):
    rng = np.random.default_rng(5)
    angles = (0.4 + rng.integers(0, 4, 8000) * math.pi / 2 + rng.normal(0, 0.08, 8000)) % (2 * math.pi)
    d = spark.createDataFrame([("s", float(a)) for a in angles], "dataset string, o double")
    got = {r.param: r.value for r in fit.primary_angles(d, "o", 4, 180).collect()}
    assert sorted((got[f"a{k}"] % (math.pi / 2)) for k in range(4)) == pytest.approx([0.4] * 4, abs=0.03)
    x = np.arange(0, 4, 0.1)
    curve = spark.createDataFrame([("s", float(v), float(5 - 2 * (v - 1.73) ** 2)) for v in x], "dataset string, r double, g double")
    top = fit.parabola_peak(curve, "r", "g", 1.7, 1.0).first()
    assert (top.at, top.height) == pytest.approx((1.73, 5.0))


def test_propagated_errors(spark):
    for kind, errors in (("nn", (0.02, 0.0)), ("rn", (0.02, 0.1)), ("rr", (0.1, 0.0))):
        got = fit.propagated(spark, kind, errors).first()
        assert got.sampled == pytest.approx(got.predicted, rel=0.05), kind


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.gamma(2.0, 1.0, 300)
    r = groups.moments(spark.createDataFrame([("a", float(x)) for x in v], "k string, v double"), "v", ["k"]).first()
    c = v - v.mean()
    assert (r.skew, r.kurtosis) == pytest.approx(((c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3))
    normal = noise.velocity_stats(spark.range(4000).select(*[simulate.hashed_normal(F.col("id"), k).alias(c) for k, c in enumerate(("o", "perp", "par"))])).collect()
    assert all(abs(x.skew_z) < 4 and abs(x.kurtosis_z) < 4 for x in normal)


def test_shells_follow_the_track(spark):
    grid = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    rows = [(t, f, 100 * f + t, x * 1.0 + 0.3 * f * (t % 3), y * 1.0, 0.0) for f in range(3) for t, (x, y) in enumerate(grid)] + [(99, 2, 999, 9.0, 9.0, 0.0)]
    got = {(r.t, r.f): r.sh for r in shells.track_shells(tracks(spark, rows), 5).collect()}
    assert all(got[t, f] == max(abs(x), abs(y)) for t, (x, y) in enumerate(grid) for f in range(3)) and got[99, 2] == -1
    stats = {(r.t, r.f): r for r in shells.melt_stats(tracks(spark, rows), 5).collect()}
    centre = grid.index((0, 0))
    assert stats[centre, 0].psi == pytest.approx(1) and stats[centre, 0].dens == pytest.approx(1) and stats[centre, 0].phi == pytest.approx(1)


def tiff(image: np.ndarray, order: str = "<") -> bytes:
    """A baseline TIFF of one strip."""
    data = image.astype(order + "u2").tobytes()
    tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(data))]
    entries = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "H", v) + b"\0\0" if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data)) + data + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    places = [(12, 14), (30, 40), (44, 12)]
    y, x = np.mgrid[:56, :56]
    for k in range(3):
        image = rng.integers(0, 40, (56, 56)) + 900 * np.any([(y - a) ** 2 + (x - b - k) ** 2 <= 16 for a, b in places], 0)
        (tmp_path / f"im{k}.tif").write_bytes(tiff(image, "<>"[k % 2]))
        assert (datasets.decode(tiff(image)) == image).all()
    assert (datasets.decode(b"P5\n# made\n3 2\n255\n" + bytes(range(6))) == [[0, 1, 2], [3, 4, 5]]).all()
    assert (datasets.decode(b"P6 1 1 255\n" + bytes([1, 2, 3])) == [[2]]).all()
    with pytest.raises(ValueError):
        datasets.decode(b"no image")
    got = datasets.detect_images(spark, str(tmp_path), 4.0, frames=slice(1, None)).orderBy("f", "y").collect()
    assert [(r.f, round(r.x), round(r.y)) for r in got] == [(k, b + k, a) for k in (1, 2) for a, b in places]
    assert datasets.read_images(spark, str(tmp_path), frames=slice(0, 3, 2)).count() == 2


def test_disks_are_removed(spark):
    px = [(0, r, c, 1.0 if (r - 10) ** 2 + (c - 10) ** 2 <= 9 else 0.0) for r in range(24) for c in range(24)]
    d = spark.createDataFrame(px, "f int, r int, c int, v double")
    dots = spark.createDataFrame([(0, 10.2, 9.8)], "f int, x double, y double")
    assert detect.remove_disks(d, dots, 3.5, 0.0).agg(F.sum("v")).first()[0] == 0
    kept = detect.segments(detect.label(d, 0.5), 3, 100, 0.9, (0.0, 0.0, 5.0), keep=True).collect()
    assert [r.kept for r in kept] == [False]


def test_datasets(spark, tmp_path):
    d = tracks(spark, [(0, f, f, 1.0, 2.0, 0.5) for f in range(3)])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    datasets.save_dataset({"tracks": d}, a)
    datasets.save_dataset({"positions": d.select("f", "x", "y", "id")}, b)
    assert datasets.load_dataset(spark, a, "tp")["positions"].columns == ["f", "x", "y", "id"]
    assert {r.t for r in datasets.load_dataset(spark, b, "t")["tracks"].collect()} == {-1}
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, a, "m")
    lag.msd(d).write.parquet(f"{a}/msd")
    lag.angular_msd(d).write.parquet(f"{a}/amsd")
    assert datasets.load_msds(spark, a).count() == 3
    (tmp_path / "a" / "run_LOG.txt").write_text("x")
    assert [r.prefix.rsplit("/", 1)[1] for r in datasets.find_datasets(spark, str(tmp_path)).collect()] == ["run"]


def test_metadata(spark, tmp_path):
    meta = spark.createDataFrame([("n_8mv_50hz_a", "fps", "120"), ("n_8mv_50hz_a", "side", "17.5"), ("other", "fps", "60"), ("other", "ok", "True"), ("other", "none", "None")], "source string, key string, value string")
    t = {r.source: r for r in files.meta_table(meta, ["fps"]).collect()}
    assert (t["n_8mv_50hz_a"].mv, t["n_8mv_50hz_a"].hz, t["other"].mv) == (8, 50, -1)
    kinds = {(r.source, r.key): r.typed for r in files.typed_meta(meta).collect()}
    assert kinds["other", "fps"].int == 60 and kinds["n_8mv_50hz_a", "side"].float == 17.5 and kinds["other", "ok"].bool is True and kinds["other", "none"].text is None
    new = spark.createDataFrame([("other", "fps", "61")], "source string, key string, value string")
    got = {(r.source, r.key): r.value for r in files.update_meta(meta, new).collect()}
    assert got["other", "fps"] == "61" and got["n_8mv_50hz_a", "fps"] == "120" and len(got) == 5
    edited = {(r.source, r.key): r.value for r in files.edit_meta(meta, "fps", "side", backup="was").collect()}
    assert edited["n_8mv_50hz_a", "side"] == "120" and edited["other", "was"] == "60" and ("other", "fps") not in edited and len(edited) == 6
    doubled = files.edit_meta(meta, "fps", value=lambda v: (v.cast("int") * 2).cast("string"))
    assert {r.value for r in doubled.where("key = 'fps'").collect()} == {"240", "120"}
    assert {r.key: r.value for r in files.merge_meta(meta, "join").collect()}["fps"] == "120, 60"
    with pytest.raises(Exception, match="values differ"):
        files.merge_meta(meta, "fail").collect()
    assert files.synced({"a": None, "b": 2}, {"x": 1}, {"a": "x", "b": "y"}) == ({"a": 1, "b": 2}, {"x": 1, "y": 2})
    fits = spark.createDataFrame([("a", "nn", "dr", 1.0)], "dataset string, func string, param string, value double")
    path = str(tmp_path / "fits")
    files.save_fits(fits, path)
    files.save_fits(fits.withColumn("value", F.lit(2.0)), path, files.load_fits(spark, path))
    assert [r.value for r in files.load_fits(spark, path).collect()] == [2.0]
    assert files.gather_fits(files.load_fits(spark, path), ["dr"]).first().dr == 2.0


def test_oscilloscope(spark, tmp_path):
    lines = ["Record Length\t3\tPoints\t0.0\t1.5\t", "Units\tV\t\t0.1\t2.5\t", "\t\t\t0.2\t-1.0\t"]
    (tmp_path / "good.csv").write_text("\n".join(lines))
    got = files.read_oscilloscope(spark, str(tmp_path / "good.csv")).orderBy("t").collect()
    assert [(r.channel, r.t, r.v) for r in got] == [(0, 0.0, 1.5), (0, 0.1, 2.5), (0, 0.2, -1.0)]
    assert {(r.key, r.value) for r in files.read_oscilloscope_meta(spark, str(tmp_path / "good.csv")).collect()} == {("Record Length", "3"), ("Units", "V")}
    (tmp_path / "bad.csv").write_text("\n".join(lines[:2]))
    with pytest.raises(Exception, match="bad format"):
        files.read_oscilloscope(spark, str(tmp_path / "bad.csv")).collect()
    scope = files.read_oscilloscope(spark, str(tmp_path / "good.csv"))
    assert files.check_clipping(scope, 0.0, 1.0).count() == 3
    with pytest.raises(Exception, match="clipped"):
        files.check_clipping(scope, 0.0, 0.3).collect()


def test_text_scalars(spark):
    pairs = [("run_a1", "run_b1", "run_?1"), ("left_one_end", "left_three_end", "left_*e_end"), ("x", "x", "x"), ("ab", "xyz", "*")]
    d = spark.createDataFrame(pairs, "a string, b string, c string")
    assert all(r.got == r.c for r in d.withColumn("got", scalars.common_pattern(F.col("a"), F.col("b"))).collect())
    r = spark.range(1).select(scalars.with_error(F.lit(12.3456), F.lit(0.0234)).alias("a"), scalars.with_error(F.lit(12.3), F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == ("12.35 +- 0.02", "12.3")


def test_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([], TRACK)
    nulls = tracks(spark, [(0, f, f, None, None, None) for f in range(3)])
    for e in (d, nulls):
        for out in (
            sequence.displaced(e), sequence.variable_smooth(e, "x", F.lit(1.0)), sequence.peaks(e, "f", "x", ["t"], 2), sequence.envelope(e, "x"), sequence.cumulative_trapezoid(e, "x", "f", "t"),
            groups.stacked(e), groups.padded(e, "x"), groups.length_filter(e, -2), lag.rr_stack(e), lag.field_autocorr(e, ["x"]), noise.vv_corr(e), spatial.diameter(e), spatial.pair_distribution(e, 4, 1.0, 0.1, 0.1),
            shells.track_shells(e, 3), tracksets.frame_slice(e, "1:2"),
        ):
            out.collect()
