"""Runs of words against brute force."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from pathfield.llm import periodic

DDL = "doc_id long, text string, lang string, runs int, collapsed string, start long"


def brute(w, least=12):
    """(start, length, period) of every run, by comparing all pairs of places."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                out.setdefault((start, i + q), q)
    return sorted((s, t - s, q) for (s, t), q in out.items())


def test_texts():
    unit = st.lists(st.sampled_from("ab"), min_size=1, max_size=5)
    texts = st.lists(st.one_of(unit, st.tuples(unit, st.integers(2, 9)).map(lambda x: x[0] * x[1]), st.lists(st.sampled_from("abcdefgh"), max_size=9)), max_size=14).map(lambda parts: [x for p in parts for x in p])

    @settings(max_examples=600, deadline=None, derandomize=True)
    @given(st.lists(texts, min_size=1, max_size=4), st.sampled_from([4, 8, 12]))
    @example([["a"] * 40, ["a"] * 12, ["a"] * 11], 12)
    def check(found, least):
        split = [[x.encode() for x in t] for t in found]
        assert [sorted(x) for x in periodic.batch_runs(split, least)] == [brute(t, least) for t in split]

    check()


def test_long_words():
    """Fibonacci and Thue-Morse words, which are rich in runs and blocks, and copies of copies."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 1_500:
        a, b = b, b + a
    morse = ["ab"[bin(i).count("1") % 2] for i in range(1_024)]
    rng = np.random.default_rng(5)
    base = [str(x) for x in rng.integers(0, 3, 150)]
    copies = base + ["x"] + base * 3 + ["y"] + base[20:120] * 2 + ["z"] + base[5:] * 2
    split = [[x.encode() for x in t] for t in (b, morse, copies)]
    assert [sorted(x) for x in periodic.batch_runs(split)] == [brute(t) for t in split]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    body = lambda n, k: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    texts = [None, "", " \n\t ", "one", "a " * 30, "a\tb\n" * 9 + "c\x1cd e", body(400, 3), body(60_000, 2_000), "ä 漢 " * 8, *[body(int(n), 50) for n in rng.integers(1, 300, 120)]]
    rows = [(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)] + [(4, "a " * 30, "en", 1, "x", 2), (None, "b c " * 10, None, 1, "x", 2)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    got = periodic.op13_periodic(spark, path).collect()
    expected = []
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        found = brute(w) if len(w) < 20_000 else [tuple(r) for r in periodic.batch_runs([[x.encode() for x in w]])[0]]
        found.sort(key=lambda r: (r[0], r[2]))
        dropped = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        expected.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))
    assert sum(r.n_runs > 0 for r in got) > 10
    assert {n for r in periodic.find_runs(spark.createDataFrame(rows[4:5], DDL)).collect() for n in [tuple(x) for x in r.runs]} == {(0, 30, 1)}
    assert periodic.find_runs(spark.createDataFrame([], DDL)).count() == 0
