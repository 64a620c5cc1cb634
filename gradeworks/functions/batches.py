"""Arrow batches taken in parts of bounded size, and the tokens of texts as arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at a time; a longer text is taken whole.
SLICE = 1 << 18
#: Code points up to ё: whether a token may hold them, as in ``text.LETTERS``.
TOKEN = np.zeros(0x453, bool)
TOKEN[[*range(48, 58), *range(97, 123), *range(0x430, 0x450), 0x451]] = True


def parts(texts: Sequence[pa.Array], most: int = SLICE, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose ``texts`` take about ``most`` bytes together."""
    total = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    yield from ranges(total, most, rows)


def ranges(total: np.ndarray, most: int, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Ranges of rows of which ``total`` gives the running sum of sizes, of about ``most`` together."""
    at, n = 0, len(total)
    while at < n:
        before = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, before + most))), at + rows, n)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def tokens(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token of lower-cased texts, as ``text.tokenize`` cuts them, and how many tokens each text has."""
    letter, first, count = _runs(codes, sizes)
    if not len(first):
        return np.empty(0, U), count
    length = np.diff(first, append=len(letter))
    place = np.arange(len(letter)) - np.repeat(first, length)
    power = np.cumprod(np.concatenate((np.ones(1, U), np.full(int(length.max()), U(0x9E3779B97F4A7C15)))))
    hashed = mix(np.add.reduceat(mix(codes[letter].astype(U) + U(1)) * power[place], first) + length.astype(U))
    return hashed, count


def _runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the characters of tokens, the first of them of each token, and how many tokens each text has."""
    inside = TOKEN[np.minimum(codes, len(TOKEN) - 1)]
    begin = np.cumsum(sizes) - sizes
    before = np.concatenate(([False], inside[:-1]))
    before[begin[sizes > 0]] = False
    start = np.flatnonzero(inside & ~before)
    letter = np.flatnonzero(inside)
    return letter, np.searchsorted(letter, start), np.diff(np.searchsorted(start, np.append(begin, len(codes))))


def token_texts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts, one after the other, and how many each text has."""
    codes, sizes = points(texts)
    letter, first, count = _runs(codes, sizes)
    own = codes[letter]
    at = np.concatenate(([0], np.cumsum(1 + (own >= 0x80))))  # none takes more than two bytes
    ends = at[np.append(first, len(own))].astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(own.tobytes().decode("utf-32-le").encode())), count
