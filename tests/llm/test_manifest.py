"""The Merkle manifest against a plain version, over odd tables and all strides."""

import hashlib
import zlib

import pytest

from pathfield.llm import manifest

DDL = "doc_id long, text string, lang string, source string, n_chars long, pos int, tree string, key string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    doc_id, text, lang, source, n = r[:5]
    return sha(*(framed(v) for v in (doc_id, source, lang, None if n is None else n + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out



def _siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        out.append((i % 2 == 1, nodes[i ^ 1]) if i ^ 1 < len(nodes) else (False, None))
        i //= 2
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in langs]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            proof = _siblings(tree, i) + _siblings(top, k)
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if touched else leaf(r)
            for left, s in proof:
                node = sha(s, node) if left else sha(node, s or "")
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], sha(*(s for _, s in proof if s)), node, node == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.op11_manifest(spark, path).collect()), key=repr)


MORE = (1, "x", "y")


def test_odd_rows(spark, tmp_path):
    rows = [(i, f"text {i} ä漢😀", "en", None if i % 5 == 0 else "s", i * 3 if i % 4 else None, *MORE) for i in range(300)]
    rows += [(i, None if i % 3 else "", None if i < 9 else "", "s", 2**63 - 1, *MORE) for i in range(14)]
    rows += [(7, "same", "ä", "s", 4, *MORE)] * 70 + [(None, "no id", "fr", None, None, *MORE)] * 3 + [(5, "a" * 200_000, "z", "s", 1, *MORE)]
    rows += [(7, f"other {i}", "ä", "s", 4, *MORE) for i in range(3)]
    got = run(spark, rows, tmp_path)
    assert got == plain(rows)
    # changed rows fail and no others
    assert all(r[6] == (r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 > 0 or r[5] == r[3]) for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 128, 129])
def test_sizes(spark, tmp_path, n):
    rows = [(i, f"t{i}", None, "s", i, *MORE) for i in range(n)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("stride", [1, 3])
def test_strides_agree(spark, stride):
    rows = [(i, f"t{i}", "ab"[i % 20 == 0], "s", i, *MORE) for i in range(150)]
    docs = spark.createDataFrame(rows, DDL)
    got = manifest.manifest(docs, stride=stride).select("key", "leaf", "root", manifest.proof_digest(manifest.F.col("proof")).alias("p")).collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[1], r[3], r[4]) for r in plain(rows))
    with pytest.raises(ValueError, match="stride"):
        manifest.manifest(docs, stride=0)
