"""Vectorized words, hashes and shingles of UTF-8 texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are turned to words at a time; a longer text is taken whole.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    size = max(1 << 20, 1 << (n - 1).bit_length())
    if size not in _powers:
        made = tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, b, U)))) for b in (BASE, INVERSE))
        if size > 1 << 22:  # one very long text: not kept
            return made
        _powers[size] = made
    return _powers[size]


class Words(NamedTuple):
    buf: np.ndarray  # the texts' bytes, each text followed by a line feed
    begin: np.ndarray  # of each text in buf
    start: np.ndarray  # of each word in buf
    end: np.ndarray
    row: np.ndarray  # the word's text
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at last


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of bytes."""
    sums = np.empty(len(buf) + 1, U)
    sums[0] = 0
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf))[0][: len(buf)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def split(texts: Sequence[bytes | None], lower: bool = False, space: np.ndarray = SPACE) -> Words:
    buf = np.frombuffer(b"".join(p for t in texts for p in (t or b"", b"\n")), np.uint8)
    begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    if lower:
        buf = LOWER[buf]
    inside = np.concatenate(([0], ~space[buf])).astype(np.int8)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = np.searchsorted(begin, start, side="right") - 1
    return Words(buf, begin, start, end, row, span_hash(prefix_sums(buf), start, end), np.searchsorted(row, np.arange(len(texts) + 1)))


def slices(texts: Sequence[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= SLICE:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, m = np.zeros(n, U), 1
    for j in range(k):
        m = (m * BASE) % (1 << 64)
        out += h[j : j + n] * U(m | 1)
    return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of one text's word hashes; a shorter text is one shingle, an empty one has none."""
    if 0 < len(h) < k:
        return ngrams(h, len(h)) + U(len(h))
    return np.unique(ngrams(h, k))
