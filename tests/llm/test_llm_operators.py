"""Operators of pathfield.llm on small made-up tables: edge cases, brute force, held-out accuracy."""

import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfield.llm import common, fingerprints, jaccard, languages, licenses, mixing, neighbours, packing, quality, toxicity, urls
from pathfield.llm.common import staged
from pathfield.operators.graph import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, bucket int, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names operators use themselves."""
    words = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One\tTWO"), (5, words), (6, words + " tail"), (7, "a b c d e f g h i j k l m n o p"), (7, "a b c d e f g h i j k l m n o p"), (None, "no id at all here now"), (8, " \n "), (9, "ÄÖ ü ß 漢字 😀")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", None, 1.0, 5, 1, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def ids(df, name="doc_id"):
    return sorted((-1 if r[0] is None else r[0]) for r in df.select(name).collect())


ALL = [-1, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]


def test_toxicity(spark, odd, none, docs, labels):
    net = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(odd, net).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == ALL
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 8))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert toxicity.score_toxicity(none, net).count() == 0
    untrained = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd, untrained).count() == 11
    assert toxicity.windows(np.arange(1, 100)).max() == 99 and set(toxicity.windows(np.arange(1, 100)).ravel()) == set(range(1, 100))


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    k = toxicity.STATES
    n = lambda *s: rng.normal(0, 0.5, s)
    net = toxicity.Network({"ua": n(k, 3 * k), "ub": n(k, 3 * k), "v": n(2 * k), "o": n(2 * k), "b": n(1)}, {})
    x, mask = n(5, 3, 6 * k).astype(np.float32), np.ones((5, 3), bool)
    mask[4, 1] = False
    _, kept = net.forward(x, mask, True)
    grads, dx = net.backward(np.ones(3, np.float32), kept)
    for name in ("ua", "ub", "v", "o"):
        w = net.weights[name]
        at = tuple(0 for _ in w.shape)
        old, h = w[at], 1e-2
        w[at] = old + h
        up = net.forward(x, mask)[0].sum()
        w[at] = old - h
        down = net.forward(x, mask)[0].sum()
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-3)
    x[2, 1, 3] += 1e-2
    up = net.forward(x, mask)[0].sum()
    x[2, 1, 3] -= 2e-2
    assert dx[2, 1, 3] == pytest.approx((up - net.forward(x, mask)[0].sum()) / 2e-2, rel=0.05, abs=2e-3)


def test_toxicity_learns():
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(rng.choice(["la", "mo", "ri", "ten", "sa", "vu", "kel"], 60))
    texts = [plain() + (" zorbo " + plain() if i % 2 else "") for i in range(400)]
    net = toxicity.train(texts, np.arange(400) % 2, 0.5)
    series = __import__("pandas").Series([x for _ in range(40) for x in (plain() + " zorbo " + plain(), plain())])

    class Held:
        value = net

    (got,) = toxicity._scorer(Held, "t")(iter([series]))
    assert got[::2].mean() > 0.7 > 0.3 > got[1::2].mean()


def brute_chain(rows):
    rows = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 2
        e = t[: len(t) - n] + u[:n]
        yield i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t.encode()), fingerprints.fingerprint(e.encode())


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_fingerprints(docs, none, buckets):
    got = sorted(tuple(r)[:5] for r in fingerprints.fingerprint_chain(docs, buckets).collect())
    assert got == sorted(brute_chain((r.doc_id, r.text) for r in docs.collect()))
    assert fingerprints.fingerprint_chain(none, buckets).count() == 0


def test_fingerprints_odd(odd):
    got = fingerprints.fingerprint_chain(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == ALL
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprints.fingerprint_chain(odd.where("doc_id = 3")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"one one").hexdigest()


def brute_counts(data):
    counts = [0] * fingerprints.BUCKETS
    for k, (i, j, m) in enumerate(fingerprints.TRIPLETS):
        for a in range(len(data) - m):
            x = (data[a + i] * 0x9E3779B1 + data[a + j] * 0x85EBCA77 + data[a + m] * 0xC2B2AE3D + 0x27D4EB2F * (k + 1)) & 0xFFFFFFFF
            counts[((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    return counts


def test_bucket_counts_across_slices(monkeypatch):
    data = bytes(np.random.default_rng(0).integers(0, 256, 1000, dtype=np.uint8))
    monkeypatch.setattr(fingerprints, "SLICE", 64)
    assert fingerprints.bucket_counts(data).tolist() == brute_counts(data)


def test_urls(spark):
    given = [(1, "https://A.Example.COM/en/1?x"), (2, "http://www.example.com/en/"), (3, None), (4, "nothing"), (5, "ftp://x.net/es/a#b"), (6, "http://net/fr"), (7, "http://b.org/en/77"), (7, "http://b.org/en/77"), (8, "http://com"), (9, "://x.com/"), (10, "")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame([(i, u, "h", "r") for i, u in given], "page_id long, url string, rule string, form string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].host, got[3].path, got[3].rule) == ("", "", None) and (got[4].host, got[4].path) == ("", "")
    assert got[5].rule == "net/es/" and got[6].rule is None and got[8].rule is None and got[9].rule == "com/"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_components(rows):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, docs, odd, none):
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()]
    base = [f"t{i}" for i in range(300)]
    for k in range(120):  # near copies around the threshold: some only link through others
        w = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 9)):
            w[at] = f"z{k}-{at}"
        rows.append((1000 + k, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(70))
    for k in range(40):  # long texts that share a passage only, and near copies of a long text
        rows.append((2000 + k, " ".join(f"u{k}-{i}" for i in range(2_000)) + f" {passage} " + " ".join(f"v{k}-{i}" for i in range(3_000 + 10 * k))))
    long = [f"l{i}" for i in range(5_000)]
    for k in range(6):
        rows.append((3000 + k, " ".join(f"x{k}-{i}" if i % (37 + 3 * k) == k else w for i, w in enumerate(long))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_components(rows)
    found = jaccard.jaccard_components(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found) == ALL
    by = {r.doc_id: r for r in found}
    assert by[1].n_shingles == by[2].n_shingles == 0 and by[4].component_id == 3 and by[6].component_id == 5 and by[None].component_id is None
    assert jaccard.jaccard_components(none).count() == 0
    assert ids(jaccard.keep_one(odd)) == [-1, 1, 2, 3, 5, 7, 8, 9]
    assert jaccard.keep_one(odd).columns == odd.columns


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 130 if k < 30 else 200][rng.random(130 if k < 30 else 200) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)])) for k in range(90)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    packed = [jaccard.bitmap(s).tobytes() for s in sets]
    words = np.array([len(b) // 8 for b in packed])
    bits = jaccard._same_width(packed, words, int(words.max()))
    slack = n - np.bitwise_count(bits).sum(1, dtype=np.int64) * words // words.max()
    pairs = {(int(a), int(b)) for i, j in jaccard.SignatureTree(n, slack, np.arange(90), bits).survivors() for a, b in zip(i, j, strict=True)}
    assert len(set(words)) > 1
    for a in range(90):
        for b in range(a + 1, 90):
            if jaccard.linked(jaccard.overlap(sets[a], sets[b]), n[a], n[b]):
                assert (a, b) in pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 70), (70, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {70: 70, 100: 70, 101: 70}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses(spark, odd, none):
    given = [(1, "mit  LICENCE\n\n(c) 2019-2021, A & B\n" + licenses._MIT.replace('"', "''").upper()), (2, licenses._MIT + " and more"), (3, None), (4, "Released under the MIT License!")]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: "MIT"}
    assert ids(licenses.scan_licenses(odd)) == ALL and licenses.scan_licenses(none).count() == 0


def test_licenses_from_files_and_at_the_end(spark, tmp_path):
    for name, text in (("Own-1.0.txt", "You may use this.\nCopyright (c) 2020 A\nNothing else."), ("Other", "All rights reserved to centres.")):
        (tmp_path / name).write_text(text)
    known = licenses.known_from_files(spark, str(tmp_path))
    given = [(1, "YOU MAY USE THIS -- nothing else!"), (2, "Some text.\nAll rights reserved to  centers. \r\n\n"), (3, "all rights reserved to centers"), (4, "epicentre"), (5, "epicenter")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(given, "doc_id long, text string"), known).collect()}
    assert {i: (r.license, r.notice) for i, r in got.items()} == {1: ("Own-1.0", "Own-1.0"), 2: (None, "Other"), 3: ("Other", "Other"), 4: (None, None), 5: (None, None)}
    # spellings are whole words only
    assert got[4].digest != got[5].digest
    found = licenses.op5_license_scans(spark, "/root/testdata/sf0.01")
    assert found.where("notice is not null").count() > 0




def test_licenses_wrapped(spark):
    """Sentences wrapped before the word copyright keep it; lines that state a copyright go."""
    wrapped = [(n, textwrap.fill(t, w, break_long_words=False, break_on_hyphens=False)) for n, t in licenses.KNOWN for w in range(8, 100, 3)]
    wrapped += [("ISC", f"{line}\n\n" + licenses._ISC) for line in ("Copyright 2019 A. B.", "Copyright (c) 2001-2019, A", "copyright: Jane Doe", "Copyright Orion Labs", "# Copyright \xa9 2020", "Copyright2019 A", "Copyright holder: A. B.", "(c) 2019 A")]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wrapped)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(d).collect()}
    assert [got[i] for i in range(len(wrapped))] == [n for n, _ in wrapped]


def test_languages(odd, none, docs):
    found = languages.identify(docs)
    assert found.where("language = declared").count() >= 0.97 * docs.count()
    assert ids(languages.identify(odd)) == ALL and languages.identify(none).count() == 0
    assert languages.keep_identified(odd).columns == odd.columns
    hidden = languages.identify(docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))).join(docs, "doc_id")
    assert hidden.where("doc_id % 3 = 0 and language = lang").count() >= 0.95 * hidden.where("doc_id % 3 = 0").count()


def test_languages_are_not_capped(spark):
    """Forty declared languages, one of them nearly all copies of one text: each is found where it isn't declared."""
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choice(list(letters), 6)) for _ in range(40)] for _ in range(40)]
    text = lambda k: " ".join(rng.choice(words[k], 30))
    rows = [(k, text(k), f"l{k:02d}" if i < 10 else None, None) for k in range(40) for i in range(12)] + [(0, "copied text of the first", "l00", None)] * 3_000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = languages.fit_text_model(d.select("text", F.col("lang").alias("declared")))
    assert model.languages == [f"l{k:02d}" for k in range(40)]
    for k in range(40):
        assert model.evidence(text(k)).argmax() == k
    found = languages.identify(d).where("declared is null").collect()
    assert len(found) == 80 and all(r.language == f"l{r.doc_id:02d}" for r in found)


def test_language_posterior(spark):
    """The fused posterior against loops over the definition."""
    import math

    rows = [(1, "aaa bbb", "xx", "a.de"), (2, "aaa bab", "xx", "a.de"), (3, "ccc ddd", "yy", "b.fr"), (4, "ccc dcd", "yy", "b.fr"), (5, "aaa ccc", None, "a.de"), (6, "aaa ccc", None, "b.fr"), (7, "aaa ccc", "yy", "c.de"), (8, "", None, "c.de"), (9, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.posterior) for r in languages.identify(d).collect()}
    names = ["xx", "yy"]
    counts = {x: {} for x in names}
    grams = lambda t: [int(k) for k in np.repeat(np.arange(languages.BUCKETS), languages.trigram_counts(t))]
    for text in {(r[1], r[2]) for r in rows if r[2]}:
        for g in grams(text[0]):
            counts[text[1]][g] = counts[text[1]].get(g, 0) + 1
    told = lambda x, right, what: 1.0 if what is None else right if x == what else 1 - right

    def weights(text, declared, prior):
        out = {}
        for x in names:
            total = sum(counts[x].values())
            log = [math.log((counts[x].get(g, 0) + 0.5) / (total + 0.5 * languages.BUCKETS)) for g in grams(text or "")]
            scale = min(1.0, languages.EVIDENCE / len(log)) if log else 1.0
            out[x] = math.exp(scale * sum(log)) * told(x, languages.DECLARED, declared) * prior[x]
        return {x: w / sum(out.values()) for x, w in out.items()}

    flat = {x: 1.0 for x in names}
    first = {r[0]: max(names, key=lambda x, r=r: weights(r[1], r[2], flat)[x]) for r in rows}
    suffix = lambda h: h.rsplit(".", 1)[1] if h else None
    share = lambda which: {x: sum(first[r[0]] == x and which(r) for r in rows) for x in names}
    smooth = lambda n, above: {x: (n[x] + languages.PULL * above[x]) / (sum(n.values()) + languages.PULL) for x in names}
    whole = share(lambda r: True)
    everywhere = {x: (n + 1) / (sum(whole.values()) + 2) for x, n in whole.items()}
    for r in rows:
        prior = smooth(share(lambda o, r=r: o[3] == r[3]), smooth(share(lambda o, r=r: suffix(o[3]) == suffix(r[3])), everywhere))
        expected = weights(r[1], r[2], prior)
        best = max(names, key=expected.get)
        assert got[r[0]][0] == best and got[r[0]][1] == pytest.approx(expected[best], rel=1e-9), r


def test_language_evidence(spark):
    """Each kind of evidence changes a result: text, markup, suffix, host."""
    text = {"de": "und der die das nicht", "fr": "les des une est pas"}
    page = lambda t, lang=None: f"<!DOCTYPE html><HTML{f' class=x LANG={lang}-XX' if lang else ''}><head><style>p {{}}</style></head><p>{t}</p><script>var a = '<p>';</script></html>"
    rows = [(i, f"http://Host{i % 2}.example.com/a", page(text["de" if i % 2 else "fr"], "de" if i % 2 else "fr")) for i in range(60)]
    unclear = "qq ww"
    rows += [(100, "http://x.org/", page(text["fr"])), (101, "http://x.org/", page(unclear, "fr")), (102, "http://x.org/", page(unclear, "de")), (103, "http://y.fr/", page(unclear)), (104, "http://y.de/", page(unclear)), (105, "http://host0.example.com/", page(unclear)), (106, "http://host1.example.com/", page(unclear)), (107, None, None)]
    evidence = languages.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [(r.lang, r.source, r.text.split()) for r in evidence.where("page_id in (1, 100, 107)").na.fill("").orderBy("page_id").collect()] == [("de", "host1.example.com", text["de"].split()), ("", "x.org", text["fr"].split()), ("", "", [])]
    got = {r.page_id: r.language for r in languages.identify(evidence, keys=("page_id",)).collect()}
    assert [got[i] for i in range(100, 107)] == ["fr", "fr", "de", "fr", "de", "fr", "de"]




def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    got = packing.harmonic_pack(odd.where("doc_id <> 7"), path).collect()
    for doc_id, text in ((r.doc_id, r.text) for r in odd.where("doc_id <> 7").collect()):
        expected = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted((p for p in got if p.doc_id == doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(expected)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(expected[p.start : at], "<u4").tobytes())
        assert at == len(expected)
    assert packing.harmonic_pack(none, path).count() == 0
    bins = {}
    for p in packing.harmonic_pack(spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")), path).collect():
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = []
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        sizes.append(at)
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.03 * sum(sizes)


def test_word_encoder(monkeypatch):
    """Words between spaces and line feeds, encoded apart, give the ids of the whole text."""
    from hypothesis import example, given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    parts = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "the", "The", "don't", "12345", "x1", ".", "...", "naïve", "漢字", "😀", "\u00a0", "\u200b", "_", "--", "ß", "\x00", "\u0301", "DON'T", "Ünß.", "a'", "'s", "x_.", "İ", "ΣΑΣ.", ")-", "½.", "*a*"])

    monkeypatch.setattr(packing, "AT_ONCE", 12)

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.lists(st.one_of(st.lists(parts, max_size=12).map("".join), st.text(max_size=30)), max_size=4))
    @example(["İ."])
    @example(["\u0958)", "e\u0301.", "\u1100\u1161."])
    def check(texts):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_latin_stems_skip_the_vocabularys_steps(tmp_path):
    """Latin letters reach the model alone, once whatever their case and signs; ids stay the whole tokenizer's, also of special tokens' look-alikes and of vocabularies with other steps."""
    from tokenizers import Tokenizer, normalizers

    def same(tokenizer, encoder, texts):
        for text, data in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text

    class Spy:
        def __init__(self, inner):
            self.inner, self.given = inner, []

        def encode_batch_fast(self, texts, **options):
            self.given += texts
            return self.inner.encode_batch_fast(texts, **options)

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    encoder.tokenizer, encoder.letters = Spy(encoder.tokenizer), Spy(encoder.letters)
    same(plain, encoder, ["The THE, the\nNaïve. naïve ", "", " the", "NAÏVE!"])
    assert sorted(encoder.letters.given) in (["naïve the"], ["the naïve"]) and set(encoder.tokenizer.given) <= set(packing.SIGNS)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    same(plain, encoder, [" ".join(a + b for b in letters) for a in letters])
    same(plain, encoder, ["<|ENDOFTEXT|>a. <|endoftext|>a.", "<|StartOfText|>B <|startoftext|>B", "x<|endoftext|>"])
    assert encoder.encode([]) == []
    other = Tokenizer.from_file(path)
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "cased.json"))
    same(other, packing.WordEncoder(str(tmp_path / "cased.json")), ["the The THE. naïve NAÏVE, 漢字"])


def test_stems_forgotten(monkeypatch):
    """A worker that starts anew, and cuts that end a stretch, change no ids."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "STEM_CHARS", 10)
    monkeypatch.setattr(packing, "AT_ONCE", 8)
    texts = ["the cats. The dogs, THE", "a cat", "12345678", "", "cats dogs\n\nthe..."] * 3
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_stems_asked_for_again_are_kept(monkeypatch):
    """What a worker keeps stays within the bound: stems of one stretch alone go, the others stay, and no id changes."""
    import tracemalloc

    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "STEM_CHARS", 300_000)
    tokenize, new = encoder._tokenize, []
    monkeypatch.setattr(encoder, "_tokenize", lambda stems: (new.extend(s for s in stems if len(s) < 12), tokenize(stems)))
    letters = "abcdefghijklmnop"
    rare = lambda k: "".join(letters[k >> 4 * i & 15] for i in range(5)) + "qrstuvw"
    tracemalloc.start()
    for at in range(0, 200_000, 5_000):
        texts = ["The cats, often. " + " ".join(map(rare, range(at + i, at + 5_000, 5))) for i in range(5)]
        found = encoder.encode(texts)
        if at % 50_000 == 0:
            assert [np.frombuffer(b, "<u4").tolist() for b in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 15_000_000 and encoder.chars <= 300_000 + 12 * 5_000
    assert sorted(new) == [",", ".", "The", "cats", "often"] and rare(0) not in encoder.known
    # more stems than the bound allows, asked for again and again: none can stay
    for _ in range(3):
        texts = [" ".join(map(rare, range(at, at + 5_000))) + " cats." for at in range(0, 20_000, 5_000)]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        for at in range(30_000, 50_000, 5_000):
            encoder.encode([" ".join(map(rare, range(at, at + 5_000)))])


def test_tasks_that_read_texts_get_bounded_batches(spark, monkeypatch):
    """The packing's workers and the pipeline's text comparisons get their texts in small Arrow batches; the session's setting comes back, after an error too."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    assert before not in (str(packing.BATCH_BYTES), str(corpus_pipeline.BATCH_BYTES))
    docs = spark.range(6_000).selectExpr("id as doc_id", "concat(id, repeat(' word', 400)) as text", "'en' as lang", "'s' as source", "2000L as n_chars").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([{"n": b.nbytes}])

    def staged(df, label):
        seen.append(max(r.n for r in docs.mapInArrow(sizes, "n long").collect()))
        return common.staged(df, label)

    monkeypatch.setattr(packing, "staged", staged)
    monkeypatch.setattr(corpus_pipeline, "keep_one", lambda d: staged(d, "kept"))
    assert packing.harmonic_pack(docs, packing.tokenizer_path()).count() >= 6_000
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 6_000
    assert len(seen) == 2 and seen[0] < 1.2 * packing.BATCH_BYTES and seen[1] < 1.2 * corpus_pipeline.BATCH_BYTES
    with pytest.raises(ValueError), common.arrow_batches(spark, 1 << 20):
        raise ValueError
    assert spark.conf.get(name) == before


def test_every_code_point_before_every_sign():
    """Signs behind any code point, alone or behind a letter, keep the tokenizer's ids."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    letters = [c for c in points if packing.WordEncoder.parts(c + ".") != (c + ".", "")]
    signs = ["."] + [s for s in packing.SIGNS if s != "."]
    for k, sign in enumerate(signs):
        words = [x + sign for c in (letters if k == 0 else letters[k :: len(signs)]) for x in (c, "x" + c)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            wanted = plain.encode_batch_fast(part, add_special_tokens=False)
            wrong = [w for w, b, e in zip(part, encoder.encode(part), wanted, strict=True) if np.frombuffer(b, "<u4").tolist() != e.ids]
            assert not wrong, wrong[:10]


def test_packing_ranks_over_workers(spark):
    """Short pieces of many workers fill common bins."""
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.repeat(F.lit(" b"), (F.col("id") % 7).cast("int"))).alias("text")).repartition(23)
    got = packing.harmonic_pack(docs, packing.tokenizer_path()).collect()
    assert len(got) == 4_000
    bins = {}
    for p in got:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(p.length for p in got) // 2048 + 9


def test_mixing(spark, odd, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 > 0, "big").when(F.col("id") % 20 == 0, "small").alias("source"))
    counts = {r.source: r["count"] for r in mixing.poisson_mix(docs).groupBy("source").count().collect()}
    assert all(abs(n - 20_000 / 3) < 400 for n in counts.values()) and len(counts) == 3
    shares = spark.createDataFrame([("big", 3.0), ("small", 1.0)], "source string, share double")
    counts = {r.source: r["count"] for r in mixing.poisson_mix(docs, shares, 8000).groupBy("source").count().collect()}
    assert abs(counts["big"] - 6000) < 300 and abs(counts["small"] - 2000) < 300 and None not in counts
    # the same rows whatever the partitions
    a, b = (sorted(r.shuffle_key for r in mixing.poisson_mix(d).collect()) for d in (docs, docs.repartition(3)))
    assert a == b
    assert mixing.poisson_mix(odd).count() >= 0 and mixing.poisson_mix(none).count() == 0
    cdf = spark.range(1).select(mixing.cumulative(F.lit(12.0)).alias("c")).first().c
    assert cdf[-1] == pytest.approx(1) and sum(1 - x for x in cdf) == pytest.approx(12)


def test_mixing_at_large_rates(spark):
    """One text of a rare source, a million copies; the columns of the caller stay, whatever their names."""
    docs = spark.createDataFrame([(1, "a", "rare", 7, 8, 9, 10), (2, "b", None, 70, 80, 90, 100)], "doc_id long, text string, source string, copy long, shuffle_key int, n int, key int")
    got = mixing.poisson_mix(docs, rows=2_000_000)
    assert got.columns == [*docs.columns, "copy_", "shuffle_key_"]
    seen = got.groupBy("doc_id", "copy", "shuffle_key", "n", "key").agg(F.count("*").alias("times"), F.min("copy_").alias("lo"), F.max("copy_").alias("hi"), F.count_distinct("copy_").alias("kinds")).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in seen] == [(1, 7, 8, 9, 10), (2, 70, 80, 90, 100)]
    assert all(abs(r.times - 1_000_000) < 6_000 and r.lo == 1 and r.hi == r.kinds == r.times for r in seen)
    counts = [r["count"] for r in mixing.poisson_mix(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source")), rows=40_000).groupBy("doc_id").count().collect()]
    assert np.mean(counts) == pytest.approx(100, abs=2) and np.var(counts) == pytest.approx(100, rel=0.25)


def test_quality(odd, none, docs, labels):
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(odd, model).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == ALL and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(none, model).count() == 0 and quality.keep_quality(odd, model).columns == odd.columns
    assert quality.score_quality(odd, quality.fit_quality(docs, labels.limit(0))).where("score between 0.49 and 0.51").count() == 11


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    score = quality.fit_additive(x[:3000], y[:3000]).score(x[3000:])
    assert ((score > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.98 * got.count()
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.96 * got.count()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [1.0] * 5), (None, [1.0] * 16)]
    d = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(4)
    got = {}
    for r in neighbours.nearest(d, block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        best = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:5]
        hits += len({i for i, _ in got[q]} & set(best))
        assert all(v == pytest.approx(s[i]) for i, v in got[q])
    assert hits >= 0.9 * 5 * 18 and set(got) == set(range(0, 900, 50))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]  # ties: the smallest ids of the equal vectors
    assert neighbours.nearest(d.limit(0)).count() == 0 and neighbours.nearest(d.where("vec_id = 50")).count() == 0


def test_neighbours_among_near_copies(spark):
    """A full chunk of 4,096 rows, a third of all rows being near copies of one vector."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4_500, 16))
    x[::3] = x[0] + 1e-3 * rng.normal(size=(1_500, 16))
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {}
        for r in neighbours.nearest(d).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    u = x / np.sqrt((x**2).sum(1, keepdims=True))
    for q in range(0, 4_500, 50):
        s = u @ u[q]
        s[q] = -2
        assert got[q] == np.argsort(-s)[:5].tolist()


def test_pipeline(spark, odd, none):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, rows, DATA), name)
            assert name == "packing" or out.columns == rows.columns
            rows = out if name != "packing" else rows
    assert corpus_pipeline.run(spark, DATA).count() > 0


CLASHING = "row long, key long, found long, id long, host long, source_ long, n long, c long, one long, doc long, prior long, bucket long, tie long, digest long, copy long, rank long"


def test_names_of_the_caller_stay(spark, docs, labels):
    """Every stage of the pipeline over a table whose other columns have the names that operators use themselves."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    extra = docs.limit(60).select("*", *[F.lit(k).cast("long").alias(n) for k, n in enumerate(names)])
    model = quality.fit_quality(extra, labels)
    for kept in (quality.keep_quality(extra, model), languages.keep_identified(extra), jaccard.keep_one(extra), mixing.poisson_mix(extra).select(*extra.columns)):
        assert kept.columns == extra.columns
        seen = kept.select(*names).distinct().collect()
        assert [tuple(r) for r in seen] == [tuple(range(len(names)))]
    for other in (fingerprints.fingerprint_chain(extra), packing.harmonic_pack(extra, packing.tokenizer_path()), licenses.scan_licenses(extra), languages.identify(extra), jaccard.jaccard_components(extra)):
        assert other.count() >= 60


def test_fits_are_the_same_every_time(spark, docs, labels):
    """Repeated ids, in any order and partitions, give the same model."""
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), F.col("text"))))
    a, b = (quality.fit_quality(d, labels) for d in (twice, twice.repartition(5, "text")))
    texts = [r.text for r in docs.limit(20).collect()]
    x = np.array([quality.features(t) for t in texts], float)
    assert a.score(x).tolist() == b.score(x).tolist()
