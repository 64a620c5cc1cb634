"""Byte-level BPE as a product of parts: halves are encoded alone and joined by encoding anew only around their border."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import packed
from gradeworks.llm.words import SPACE, U, prefix_sums, slices, span_hash

#: Bytes that are merged directly, those up to which a piece's tokens are remembered, and those of a window that is merged without a heap.
LEAF, SHORT, PLAIN = 4, 8, 32
#: Parts that a task remembers, and short pieces and windows.
MOST, MOST_SHORT = 1 << 20, 1 << 18
#: Characters of one byte: 1 a letter, 2 a digit, 3 any other but white space and controls, 4 an apostrophe.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = [1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if chr(c) == "'" else 3 for c in range(0x21, 0x7F)]
#: Lead bytes of two-byte characters of which none is white space, and of those that are all letters (Latin and Cyrillic).
LEAD, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
LEAD[0xC3:0xE0] = True
LETTERS[0xC4:0xCA] = True
LETTERS[0xD0:0xD2] = True
#: The second bytes of C3 that make no letter, and of D2 none is taken.
SIGNS = (0x97, 0xB7)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The BPE of single pieces: of the adjacent pairs of tokens that form a token, the one of lowest rank, the leftmost first, is merged until none is left."""

    def __init__(self, rank: dict[bytes, int]) -> None:
        self.rank = rank
        self.short: dict[bytes, list[bytes]] = {}
        self.windows: dict[tuple[bytes, bytes], list[bytes]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """All merges of a piece, in order of (rank, place)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) <= PLAIN:
            get = self.rank.get
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    r = get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                whole = parts[i] + parts[after[i]]
                if (r := self.rank.get(whole)) is not None:
                    heapq.heappush(heap, (r, i, whole))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != whole:
                continue  # a side was merged meanwhile
            parts[i], parts[j], after[i] = whole, b"", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def window(self, a: bytes, b: bytes) -> list[bytes]:
        """The BPE of two neighbouring tokens' bytes; where it is these two again, their border stays."""
        found = self.windows.get((a, b))
        if found is None:
            if len(self.windows) >= MOST_SHORT:
                self.windows.clear()
            found = self.windows[a, b] = self.merge(a + b)
        return found

    def stays(self, a: bytes, b: bytes) -> bool:
        w = self.window(a, b)
        return len(w) == 2 and w[0] == a

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """The tokens of two pieces' bytes together, from the tokens of each.

        Around the border a window is encoded anew. It grows until its outer tokens and those beyond it are
        neighbours that stay. Then all neighbours stay, and so does the whole: the first merge across some
        border would be the first one of those two tokens alone as well, since until then nothing has been
        merged over their outer ends.
        """
        k, window = 1, self.window(a[-1], b[0])
        while True:
            lo, hi = max(0, len(a) - k), min(k, len(b))
            if (lo == 0 or self.stays(a[lo - 1], window[0])) and (hi == len(b) or self.stays(window[-1], b[hi])):
                return a[:lo] + window + b[hi:]
            k *= 2
            window = self.merge(b"".join(a[-k:] + b[:k]))

    def encode(self, piece: bytes) -> list[bytes]:
        """The tokens of a piece: its halves', joined."""
        found = self.short.get(piece)
        if found is None:
            if len(piece) <= LEAF:
                found = self.merge(piece)
            else:
                mid = (len(piece) // 2 + LEAF - 1) // LEAF * LEAF  # whole leaves, which are often known
                found = self.join(self.encode(piece[:mid]), self.encode(piece[mid:]))
            if len(piece) <= SHORT:
                if len(self.short) >= MOST_SHORT:
                    self.short.clear()
                self.short[piece] = found
        return found


def borders(buf: np.ndarray) -> np.ndarray:
    """Where no match of a pattern such as ``Encoder`` asks for can reach over, before each byte of ``buf``.

    Those are the places between a character and white space after it, and those between letters, digits and
    other characters of one byte, an apostrophe apart, which a contraction may follow.
    """
    kind = KIND[buf]
    begins, ends = kind.copy(), kind.copy()  # of the character that begins or ends at a byte
    if (buf >= 0x80).any():
        two = np.flatnonzero(LETTERS[buf[:-1]] | ((buf[:-1] == 0xC3) & (buf[1:] != SIGNS[0]) & (buf[1:] != SIGNS[1])))
        begins[two] = ends[two + 1] = 1
        other = np.flatnonzero(LEAD[buf[:-1]])
        ends[other[ends[other + 1] == 0] + 1] = 5  # no white space, that much is known
    out = np.zeros(len(buf), bool)
    left, right = ends[:-1], begins[1:]
    out[1:] = ((left > 0) & SPACE[buf[1:]]) | ((left > 0) & (left < 4) & (right > 0) & (right != left) & ~((left == 3) & (right == 4)))
    return out


class Encoder:
    """Ids of texts by ranks: ``pattern`` cuts a text into pieces; a piece that is a token itself is that token, any other its BPE.

    With ``parted``, a match of the pattern holds letters, digits or other characters, after one space at most, or only
    white space, or a contraction after an apostrophe. A text is then cut at its ``borders``, where parts join by mere
    concatenation, and each distinct part is encoded once.
    """

    def __init__(self, path: str, pattern: str, parted: bool = True) -> None:
        import regex

        self.rank, self.pieces, self.parted = read_ranks(path), regex.compile(pattern).findall, parted
        self.merges = Merges(self.rank)
        self.token = {i: t for t, i in self.rank.items()}
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes = np.empty(0, U), np.empty(0, np.int64)
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def part(self, raw: bytes) -> list[int]:
        """The ids of a part; bytes that are no UTF-8 count as U+FFFD."""
        out, rank = [], self.rank
        for piece in self.pieces(raw.decode(errors="replace")):
            whole = piece.encode()
            if (found := rank.get(whole)) is not None:
                out.append(found)
            else:
                out += [rank[t] for t in self.merges.encode(whole)]
        return out

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.keys) > MOST or len(self.ids) > 8 * MOST:
            self.clear()
        size = np.array([len(t or b"") for t in texts], np.int64)
        begin = np.cumsum(size) - size
        raw = b"".join(t for t in texts if t)
        if not raw:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        opens = borders(buf) if self.parted else np.zeros(len(buf), bool)
        opens[begin[size > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(buf))
        kinds, where, inverse = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, kinds)
        fresh = np.ones(len(kinds), bool)
        old = place < len(self.keys)
        fresh[old] = self.keys[place[old]] != kinds[old]
        if fresh.any():
            made = [self.part(raw[a:b]) for a, b in zip(start[where[fresh]].tolist(), end[where[fresh]].tolist(), strict=True)]
            self.keys = np.insert(self.keys, place[fresh], kinds[fresh])
            self.codes = np.insert(self.codes, place[fresh], len(self.at) - 1 + np.arange(len(made)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.uint32)))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(m) for m in made])))
        code = self.codes[np.searchsorted(self.keys, kinds)][inverse]
        first, n = self.at[code], self.at[code + 1] - self.at[code]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, np.append(begin, len(buf)))])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: the product of single tokens' bytes. An id without a token is an error."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _file(path: str) -> str:
    """The ranks on this executor: the path itself, or the file that the driver has sent under its name."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False, parted: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) for each row of ``docs``; with ``decoded`` also the bytes that the ids stand for.

    Null and empty texts have no ids; repeated rows and null doc_ids stay, an empty table gives none, other columns
    of any name are left out. Texts are encoded where they lie, no row is shuffled.
    """
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(_file(ranks), pattern, parted)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, counts = encoder(texts[lo:hi])
                each = np.split(ids, np.cumsum(counts)[:-1])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.decode(x) for x in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = packed(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'doc_id' else 'binary'}" for n in names))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, decoded (bytes) for each row (doc_id, ids) of ``encoded``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(_file(ranks), "", False)
        for batch in batches:
            texts = [encoder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
