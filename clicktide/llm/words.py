"""Words of many texts at once, as 64-bit hashes, by array operations.

A word is a run of bytes that the table ``SPACE`` does not mark; texts are UTF-8.
Hashes depend on nothing but the bytes of a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
# white space of [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# everything ASCII that is no letter or digit
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits; one value for one value."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x632BE59BD9B4E019))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least ``n`` of them."""
    return _powers(1 << max(16, int(n).bit_length()))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and where each text begins and the last ends; null is empty."""
    arr = texts.cast(pa.large_string()) if not pa.types.is_large_binary(texts.type) else texts
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_large_string(arr.type) else b"")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    start: np.ndarray  # its first byte
    end: np.ndarray  # after its last byte
    first: np.ndarray  # of each text, its first word; then the number of words
    doc: np.ndarray  # of each word, its text


def words(body: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Words of the texts that lie in ``body`` at ``at``."""
    n = len(body)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(at), np.int64), none)
    inside = ~space[body]
    edge = np.empty(n + 1, dtype=bool)  # a word may begin or end here
    edge[0] = edge[n] = True
    edge[1:n] = inside[1:] != inside[:-1]
    edge[at] = True
    cut = np.flatnonzero(edge)
    begin, end = cut[:-1], cut[1:]
    is_word = inside[begin]
    begin, end = begin[is_word], end[is_word]
    up, down = powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[LOWER[body] if lower else body] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(hashes, begin, end, first, doc)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words inside one text, and the index of its first word."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * U(BASE) + w.hashes[at + i]
    return mix(h), at


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of hash and text, by text and then hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words of each text; a shorter text has itself as its one shingle."""
    h, at = windows(w, k)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    parts, docs = [h], [w.doc[at]]
    for size in range(1, k):
        some = short[count[short] == size]
        whole = np.full(len(some), size, np.uint64)
        for i in range(size):
            whole = whole * U(BASE) + w.hashes[w.first[some] + i]
        parts.append(mix(whole))
        docs.append(some)
    return distinct_by_doc(np.concatenate(parts), np.concatenate(docs))
