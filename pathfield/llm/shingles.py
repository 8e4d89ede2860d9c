"""Word shingles of texts as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19

# Odd multipliers of the hashes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_FEW = 0x8EBC6AF09C88C6E3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    size = max(CHUNK, n) + 2
    if size in _powers:
        return _powers[size]
    both = []
    for x in (_BASE, _INVERSE):
        p = np.full(size, x, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if size == CHUNK + 2:
        _powers[size] = (both[0], both[1])
    return both[0], both[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.concatenate([_FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]])
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    space = data == 32
    edges = np.diff(np.concatenate([[True], space]).view(np.int8))
    begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    words = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(_FEW))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(begin, text_ends)
    n = len(words) - WORDS + 1
    if n > 0:
        whole = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            whole += words[k : k + n] * _PLACE[k]
        whole = _mix(whole)
    out, first = [], 0
    for stop in last:
        count = stop - first
        if count >= WORDS:
            found = np.sort(whole[first : stop - WORDS + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif count:
            out.append(_mix((words[first:stop] * _PLACE[:count]).sum(keepdims=True) + np.uint64(int(count) * _FEW & (1 << 64) - 1)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = stop
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct 5-word shingles.

    Words are stretches without space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased. A text with
    fewer words has its whole sequence as one shingle, one without words, or null, none.
    """
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        if part and size + len(data) > CHUNK:
            out += _chunk_sets(part)
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    return out + (_chunk_sets(part) if part else [])


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
