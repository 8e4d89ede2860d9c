"""Benchmark decontamination against brute force."""

import hashlib
import re

import numpy as np
import pytest

from pathfield.llm import leaks

DOCS, ITEMS = "doc_id long, text string, lang string, spans int, items string, row long", "item_id long, text string, length int"


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t, *_ in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        found = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    body = lambda n, k: " ".join(f"W{x}" for x in rng.integers(0, k, n))
    passages = [body(n, 40) for n in (10, 11, 25, 60, 140)]
    items = [(i, p, 1) for i, p in enumerate(passages)] + [(10, "Short, item!", 1), (11, "ÄÖ ü 漢字", 1), (12, None, 1), (13, "", 1), (14, "?!", 1), (2, passages[2] + " tail", 1), (2, passages[2], 1), (None, passages[3][:90], 1), (100, passages[4], 1)]
    docs = [(1, None), (2, ""), (3, "..."), (4, "a short ITEM b"), (5, "ÄÖ ü 漢字 x"), (6, passages[0]), (7, passages[2] + " and " + passages[2]), (7, passages[2] + " and " + passages[2]), (None, passages[3]), (8, "ab " * 50_000 + passages[4] + " ba" * 50_000)]
    docs += [(20 + i, body(int(n), 40) + "\n" + str(rng.choice(passages)) + " " + body(20, 40)) for i, n in enumerate(rng.integers(0, 300, 60))]
    docs += [(100 + i, body(200, 3)) for i in range(20)]
    # pieces of passages, one word short of a window and just as long
    docs += [(200 + n, " ".join(passages[3].split()[5 : 5 + n]) + " end") for n in range(8, 13)]
    return [(i, t, "en", 1, "x", 3) for i, t in docs], items


def run(spark, docs, items, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return sorted((tuple(r) for r in leaks.op12_leaks(spark, path).collect()), key=repr)


def test_query(spark, tables, tmp_path):
    docs, items = tables
    assert run(spark, docs, items, tmp_path) == brute(docs, items)


def test_empty_tables(spark, tables, tmp_path):
    docs, items = tables
    assert run(spark, docs, [], tmp_path / "a") == brute(docs, [])
    assert run(spark, [], items, tmp_path / "b") == []
    assert run(spark, docs, [(1, None, 1), (2, "--", 1)], tmp_path / "c") == brute(docs, [])


def test_shards_and_blocks_agree(spark, tables):
    docs, items = (spark.createDataFrame(t, d) for t, d in zip(tables, (DOCS, ITEMS), strict=True))
    whole = leaks.find_leaks(docs, items).select("doc_id", "n_words", "spans", "items")
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    expected = key(whole)
    assert key(leaks.find_leaks(docs, items, shard=50).select("doc_id", "n_words", "spans", "items")) == expected
    assert key(leaks.find_leaks(docs, items, block=300).select("doc_id", "n_words", "spans", "items")) == expected


def test_longest_matches_and_clean(spark, tables):
    docs, items = tables
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    left = leaks.clean(d, i)
    assert left.columns == d.columns
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(repr(r) for r, x in zip(docs, (next(b for b in brute([r], items)) for r in docs), strict=True) if not x[5])
    for shard in (100, 1_000_000):
        got = {(r.item_id, r.item_start): r for r in leaks.longest_matches(leaks.find_leaks(d.where("doc_id is not null"), i.where("item_id in (0, 1, 3, 4, 10)"), shard=shard)).collect()}
        split = {i: words(t) for i, t, *_ in docs if i is not None}
        for item, text, *_ in items:
            if item not in (0, 1, 3, 4, 10):
                continue
            w = words(text)
            for s in range(max(len(w) - 9, 1)):
                best = 0
                for v in split.values():
                    for k in range(len(v)):
                        n = 0
                        while s + n < len(w) and k + n < len(v) and w[s + n] == v[k + n]:
                            n += 1
                        best = max(best, n)
                if best >= min(10, len(w)):
                    r = got[str(item), s]
                    assert r.length == best and split[r.doc_id][r.start : r.start + best] == w[s : s + best]
                else:
                    assert (str(item), s) not in got


def test_suffix_array():
    rng = np.random.default_rng(2)
    for k in (2, 5, 1_000_000):
        text = np.concatenate([rng.integers(0, k, 400), np.arange(1, 30), np.arange(1, 30), [0]])
        array = leaks.suffix_array(text, 50)
        # words behind a 0 are not compared
        shown = [tuple((x := text[a : a + 50].tolist() + [0])[: x.index(0)]) for a in array]
        assert shown == sorted(shown) and sorted(array) == np.flatnonzero(text).tolist()
