"""Vectorised text features over raw UTF-8 buffers: word hashes, shingles and hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loomgraph.llm.common import SLICE_BYTES, doc_slices

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: ASCII controls, white space and punctuation become a space; letters, digits and non-ASCII bytes stay.
WORDS = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        WORDS[_c] = 32
#: As WORDS, and digits become spaces too.
LETTERS = WORDS.copy()
LETTERS[48:58] = 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _PINV)):
            t = np.full(n, p, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def _words(b: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of non-spaces in ``b``; runs also break at the positions ``starts_at``."""
    on = b != 32
    edge = np.empty(len(b) + 1, bool)
    edge[0] = on[0]
    edge[1:-1] = on[1:] & ~on[:-1]
    edge[-1] = False
    s = starts_at[(starts_at > 0) & (starts_at < len(b))]
    edge[s] |= on[s]
    start = np.flatnonzero(edge)
    if not len(start):
        return np.zeros(0, np.uint64), start
    fin = np.empty(len(b) + 1, bool)
    fin[0] = False
    fin[1:-1] = on[:-1] & ~on[1:]
    fin[-1] = on[-1]
    fin[s] |= on[s - 1]
    end = np.flatnonzero(fin)
    p, pinv = _tables(len(b) + 1)
    acc = np.empty(len(b) + 1, np.uint64)
    acc[0] = 0
    v = b.astype(np.uint64)
    v *= p[: len(b)]
    np.cumsum(v, out=acc[1:])
    h = (acc[end] - acc[start]) * pinv[start]
    return mix(h + (end - start).astype(np.uint64) * _M2), start


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the document's words in order) for every document of a buffer of lower-cased text.
    A long document goes in slices that end at spaces; a slice grows until it has one, so a word's hash never depends on where it stands."""
    for i, j in doc_slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * SLICE_BYTES:
            if hi == lo:
                yield from ((k, np.zeros(0, np.uint64)) for k in range(i, j))
                continue
            at = offsets[i:j] - lo
            h, start = _words(table[raw[lo:hi]], at)
            cut = np.searchsorted(start, np.append(at, hi - lo))
            for k in range(i, j):
                yield k, h[cut[k - i] : cut[k - i + 1]]
        else:
            parts, none = [], np.zeros(0, np.int64)
            while lo < hi:
                end = min(hi, lo + SLICE_BYTES)
                b = table[raw[lo:end]]
                while end < hi:
                    space = np.flatnonzero(b[1:] == 32)
                    if len(space):
                        b = b[: space[-1] + 1]
                        break
                    end = min(hi, lo + 2 * (end - lo))
                    b = table[raw[lo:end]]
                parts.append(_words(b, none)[0])
                lo += len(b)
            yield i, np.concatenate(parts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a document of fewer words is one shingle of all of them."""
    if len(words) <= 1 or n == 1:
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _P + words[k : len(words) - n + 1 + k]
    return mix(h)


def ngram_counts(raw: np.ndarray, offsets: np.ndarray, dim: int, table: np.ndarray | None, n: int = 3) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, end, counts[documents, dim]) of hashed byte n-grams, over whole texts.
    N-grams with two spaces in a row after ``table`` is applied are left out."""
    shift = np.uint32(32 - int(dim).bit_length() + 1)
    for i, j in doc_slices(offsets, SLICE_BYTES // 4):
        while i < j:  # dense counts of at most 256 documents at a time
            k = min(j, i + 256)
            lo, hi = int(offsets[i]), int(offsets[k])
            out = np.zeros((k - i) * dim, np.float32)
            for a in range(lo, hi, SLICE_BYTES):  # one round unless a single document is longer
                b = raw[a : min(hi, a + SLICE_BYTES + n - 1)]
                if len(b) < n:
                    continue
                b = b if table is None else table[b]
                h = np.zeros(len(b) - n + 1, np.uint32)
                for g in range(n):
                    h = h * np.uint32(0x01000193) + b[g : len(b) - n + 1 + g]
                h *= np.uint32(0x9E3779B1)
                h >>= shift
                ok = ~((b[: len(h)] == 32) & (b[1 : len(h) + 1] == 32))
                key = h if k - i == 1 else _doc_of(offsets[i : k + 1] - a, len(h), n, ok) * dim + h
                out += np.bincount(key[ok], minlength=len(out)).astype(np.float32)
            yield i, k, out.reshape(k - i, dim)
            i = k


def _doc_of(at: np.ndarray, m: int, n: int, ok: np.ndarray) -> np.ndarray:
    """Document of each n-gram; clears ``ok`` where an n-gram crosses into the next document."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:m]
    for g in range(1, n):
        cross = at[1:-1] - g
        ok[cross[(cross >= 0) & (cross < m)]] = False
    return doc


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """sqrt(count) x idf with Euclidean length 1; an empty row stays 0. Overwrites ``counts``."""
    np.sqrt(counts, out=counts)
    counts *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    counts /= np.where(norm > 0, norm, 1)[:, None]
    return counts


def idf_of(counts: np.ndarray) -> np.ndarray:
    df = (counts > 0).sum(axis=0)
    return (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
