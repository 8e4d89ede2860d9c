"""Scores and likenesses of whole texts against slow versions that go word by word, byte by byte."""

import math
from bisect import bisect_right

import numpy as np
import pytest

from pathfield.llm import fingerprints, quality, toxicity

DATA = "/root/testdata/sf0.001"
TEXTS = ["one two", "", " \n", "A a b b, c!\nA a b b, c!\n" * 9, "x" * 3_000 + " end", "漢字 ÄÖ ü 😀 " * 40, " ".join(f"w{i % 91}x{i % 7}" for i in range(400)), "a\tb\nc\n\n1 2 $%"]


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def word_vector(net, word):
    """A known word's own vector and the mean of those of its marked 3- to 5-grams, hashed sign by sign."""
    signs, found = [ord(c) for c in f"<{word}>"], []
    for n in (3, 4, 5):
        for at in range(len(signs) - n + 1):
            h = signs[at] * 0x9E3779B1 % 2**32
            for c in signs[at + 1 : at + n]:
                h = ((h ^ h >> 15) * 0x85EBCA77 + c) % 2**32
            found.append(((h ^ h >> 13) * 0xC2B2AE3D % 2**32) >> (32 - toxicity.GRAM_BITS))
    own = net.weights["words"][net.known.get(word, 0)].astype(float)
    return own + np.mean([net.weights["grams"][g].astype(float) for g in found], 0)


def direction(x, u):
    k, h, out = len(u), np.zeros(len(u)), []
    for row in x:
        hu = u.T.astype(float) @ h
        z, r = ([sigmoid(row[i] + hu[i]) for i in range(a, a + k)] for a in (0, k))
        c = [math.tanh(row[2 * k + i] + r[i] * hu[2 * k + i]) for i in range(k)]
        h = np.array([z[i] * h[i] + (1 - z[i]) * c[i] for i in range(k)])
        out.append(h)
    return out


def toxic_score(net, text):
    w = []
    for x in text.lower().split():
        w += [x[i : i + toxicity.PART] for i in range(0, len(x), toxicity.PART)]
    if not w:
        return 0.0
    n, size = len(w), toxicity.WINDOW
    begins = [*range(0, n - size, toxicity.STEP), n - size] if n > size else [0]
    logits = []
    for b in begins:
        part = [word_vector(net, x) for x in w[b : b + size]]
        x = [v @ net.weights["w"].astype(float) + net.weights["wb"] for v in part + [np.zeros(toxicity.SIZE)] * (size - len(part))]
        k = 3 * toxicity.STATES
        ahead, back = direction([v[:k] for v in x], net.weights["ua"]), direction([v[k:] for v in x][::-1], net.weights["ub"])[::-1]
        h = [np.concatenate(p) for p in zip(ahead, back, strict=True)][: len(part)]
        share = np.exp([net.weights["v"].astype(float) @ v for v in h])
        pooled = sum(s * v for s, v in zip(share, h, strict=True)) / share.sum()
        logits.append(float(net.weights["o"].astype(float) @ pooled + net.weights["b"][0]))
    return sigmoid(net.scale * max(logits) + net.shift)


def test_toxicity_word_by_word(spark, tables):
    docs, labels = tables
    net = toxicity.fit_toxicity(docs, labels)
    assert net.constant is None
    mine = [r.text for r in docs.orderBy("doc_id").limit(6).collect()]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(TEXTS + mine)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(TEXTS + mine):
        assert got[i] == pytest.approx(toxic_score(net, t), abs=2e-4), t[:40]


def shape(text):
    """The features, by counting."""
    data, w, lines = text.encode(), text.split(), text.split("\n")
    if not w:
        return [0.0] * len(quality.FEATURES)
    n, marks = len(data), b".,;:?'\"()-"
    count = lambda f: sum(map(f, data)) / n
    symbol = lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in marks
    m = count(lambda c: c in marks)
    repeats = sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w)
    return [
        math.log1p(n), math.log1p(len(w)), n / len(w), len({*w}) / len(w), repeats, 1 - len({*lines}) / len(lines), count(lambda c: 65 <= c <= 90), count(lambda c: 48 <= c <= 57),
        count(symbol), m, len(w) / (1 + m * n), count(lambda c: c in b" \t\r\n\f\v"), count(lambda c: c > 127), len({*data}) / min(n, 256),
    ]


def test_quality_table_by_table(spark, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels)
    assert model.pairs and any(t.any() for t in model.tables)
    mine = [r.text for r in docs.orderBy("doc_id").limit(20).collect()]
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(list(enumerate(TEXTS + mine)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(TEXTS + mine):
        x = shape(t)
        assert list(quality.features(t)) == pytest.approx(x, rel=1e-12)
        logit = model.start + sum(float(table[bisect_right(list(b), v)]) for v, b, table in zip(x, model.borders, model.tables, strict=True))
        logit += sum(float(table[bisect_right(list(model.coarse[a]), x[a]), bisect_right(list(model.coarse[b]), x[b])]) for a, b, table in model.pairs)
        assert got[i] == pytest.approx(sigmoid(logit), rel=1e-9)


def digest(data):
    """A digest's parts, byte triplet by byte triplet: length code, ratios, quartile of each bucket."""
    counts = [0] * 128
    for at in range(len(data)):
        for k, (i, j, m) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
            if at + m < len(data):
                x = (data[at + i] * 0x9E3779B1 + data[at + j] * 0x85EBCA77 + data[at + m] * 0xC2B2AE3D + 0x27D4EB2F * (k + 1)) % 2**32
                counts[((x ^ x >> 15) * 0x2C1B3C6D % 2**32) >> 25] += 1
    q = sorted(counts)
    q1, q2, q3 = q[31], q[63], q[95]
    return min(255, round(math.log(len(data) + 1) / math.log(1.15))), 15 * q1 // max(q3, 1), 15 * q2 // max(q3, 1), [(c > q1) + (c > q2) + (c > q3) for c in counts]


def test_likeness_bucket_by_bucket():
    rng = np.random.default_rng(2)
    texts = [t.encode() for t in TEXTS] + [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (2, 3, 4, 50, 2_000)]
    texts += [texts[-1][:-40] + b"z" * 40, texts[-1] + b"more"]
    prints = [fingerprints.fingerprint(t) for t in texts]
    for a, p in zip(texts, prints, strict=True):
        for b, q in zip(texts, prints, strict=True):
            (la, ra, sa, ca), (lb, rb, sb, cb) = digest(a), digest(b)
            d = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(ca, cb, strict=True)) + 4 * (abs(ra - rb) + abs(sa - sb))
            d += abs(la - lb) if abs(la - lb) <= 1 else 12 * (abs(la - lb) - 1)
            assert fingerprints.likeness(p, q) == pytest.approx(1 - min(300, d) / 300)
