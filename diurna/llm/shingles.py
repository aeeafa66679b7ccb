"""Word shingles of texts as 64-bit hashes, vectorised over slices of documents.

Words are lower-cased in A-Z and cut at ASCII white space. A text's shingles are the
windows of ``k`` words; with fewer words, the whole sequence is one; without words, none.
Two shingles count as equal when their hashes are (64 bits, order-dependent).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import words_of

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent combination of two arrays of hashes."""
    x = (a ^ (a >> np.uint64(32))) * _A + b
    return (x ^ (x >> np.uint64(29))) * _B


def word_hashes(text: pa.Array):
    """(owner, hash) of every word."""
    owner, words = words_of(pc.ascii_lower(text))
    if not len(owner):
        return owner, np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    table = np.fromiter(map(h, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return owner, table[coded.indices.to_numpy()]


def shingles(text: pa.Array, k: int = 5):
    """(pointers, hashes): the shingles of text i, in order, are hashes[ptr[i] : ptr[i + 1]]."""
    owner, h = word_hashes(text)
    n = np.bincount(owner, minlength=len(text))
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < k))
    if len(h) >= k:
        whole = owner[k - 1:] == owner[:len(owner) - k + 1]
        s = h[:len(h) - k + 1]
        for j in range(1, k):
            s = mix(s, h[j:len(h) - k + 1 + j])
        s, of = s[whole], owner[k - 1:][whole]
    else:
        s, of = np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    if len(short):
        one = []
        for i in short:
            x = np.array([n[i]], np.uint64)     # the length, so that no longer window is equal
            for w in h[first[i]:first[i] + n[i]]:
                x = mix(x, np.array([w], np.uint64))
            one.append(x[0])
        s, of = np.concatenate([s, np.array(one, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    return np.searchsorted(of, np.arange(len(text) + 1)), s


def shingle_sets(text: pa.Array, k: int = 5):
    """(pointers, hashes): the distinct shingles of each text, ascending."""
    ptr, s = shingles(text, k)
    sets = [np.unique(s[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets) if sets else s
