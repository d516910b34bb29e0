"""Word and shingle hashes of a batch of texts as numpy passes over their UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2^64, taken as a difference
of prefix sums, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pkgscreen.llm.base import text_buffers

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept per process."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about ``limit`` bytes, whole texts each."""
    raw, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def _first_of_text(size: int, at: np.ndarray) -> np.ndarray:
    flag = np.zeros(size + 1, bool)
    flag[at] = True
    return flag


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs without ``[\\x20\\x09-\\x0D]``; runs end with their text."""
    edge = _first_of_text(len(raw), at)
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
    after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def kind_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``, but runs also end between word characters (letters, digits, _, non-ASCII) and other signs."""
    edge = _first_of_text(len(raw), at)
    kind = np.full(len(raw), 2, np.int8)
    kind[((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw == 95) | (raw >= 128)] = 1
    kind[(raw == 32) | ((raw >= 9) & (raw <= 13))] = 0
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    cut = np.flatnonzero(change)
    start, end = cut[:-1], cut[1:]
    keep = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``k`` words of a text; a text of 1 to k-1 words gives its whole sequence once."""
    n = len(words)
    odd = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(k)], np.uint64)
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h += words[i:n - k + 1 + i] * odd[i]
        inside = text[:n - k + 1] == text[k - 1:]
        out, of = mix(h[inside]), text[:n - k + 1][inside]
    owner, first, count = np.unique(text, return_index=True, return_counts=True)
    short = count < k
    if short.any():
        extra = np.zeros(int(short.sum()), np.uint64)
        f, c = first[short], count[short]
        for i in range(k - 1):
            has = c > i
            extra[has] += words[f[has] + i] * odd[i]
        out = np.concatenate([out, mix(extra + c.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
        of = np.concatenate([of, owner[short]])
    return out, of


def distinct_per_text(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted by text and value."""
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], text[keep]
