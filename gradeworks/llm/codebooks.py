"""Vector codes: parts of vectors by the nearest of at most 256 entries, found through remembered grid cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import cut, join_counted
from gradeworks.llm.vectors import integers, matrix

#: Integers per unit, parts of a vector, entries of a codebook, and rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: A grid cell spans 2 to this power in each dimension.
CELL = 4
#: Cells tested against a codebook at a time, points evaluated at a time, and cells that a task remembers for a codebook.
TOGETHER, BLOCK, MOST = 256, 1024, 1 << 16
#: Below this all sums of squares are exact in double precision.
EXACT = 1 << 22
LARGEST = 2**63 - 1


class Cells:
    """The entries of one codebook that can be nearest to some point of a grid cell, by cell.

    A cell is a box. An entry is dominated if even its nearest point of the box is farther from it than the
    farthest one is from another entry. Only the others are remembered, and only those are evaluated exactly.
    """

    def __init__(self, book: np.ndarray, cell: int = CELL) -> None:
        self.book, self.cell, self.known = book, cell, {}
        self.most = int(np.abs(book.astype(object)).max(initial=0))

    def _kind(self, x: np.ndarray) -> type:
        """Doubles where they are exact, Python's integers beyond."""
        return float if max(self.most, int(x.max(initial=0)), -int(x.min(initial=0))) < EXACT else object

    def _close(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and entries, pair by pair, without those that are dominated even for the balls around the boxes.

        An entry farther from the centre than the nearest one and the ball's diameter is dominated in the ball, and so
        in the box; the entry whose farthest point is nearest is never one of these.
        """
        book, centre = self.book.astype(float), low.astype(float) + (2**self.cell - 1) / 2
        square = (centre * centre).sum(1)[:, None] + (book * book).sum(1) - 2 * centre @ book.T
        far = np.sqrt(np.maximum(square, 0))
        slack = 1e-6 * (1 + np.abs(centre).max(initial=0) + np.abs(book).max(initial=0))  # above all rounding
        reach = far.min(1, keepdims=True) + np.sqrt(low.shape[1]) * (2**self.cell - 1) + slack
        return np.nonzero(far <= reach)

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that aren't dominated, by index."""
        out = []
        for i in range(0, len(cells), TOGETHER):
            low = cells[i : i + TOGETHER] << self.cell
            kind = self._kind(low)
            if kind is float:
                at, entry = self._close(low)
            else:
                at, entry = np.repeat(np.arange(len(low)), len(self.book)), np.tile(np.arange(len(self.book)), len(low))
            above = low.astype(kind)[at] - self.book.astype(kind)[entry]  # how far the box begins above the entry
            below = -above - (2**self.cell - 1)  # how far it ends below
            near, far = np.maximum(np.maximum(above, below), 0), np.maximum(-above, -below)
            first = np.searchsorted(at, np.arange(len(low)))
            able = _squares(near) <= np.minimum.reduceat(_squares(far), first)[at]
            out += np.split(entry[able], np.cumsum(np.bincount(at[able], minlength=len(low)))[:-1])
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of ``x``, the lowest of several, and its squared distance."""
        kinds, inverse = np.unique(x >> self.cell, axis=0, return_inverse=True)
        keys = [k.tobytes() for k in kinds]
        fresh = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(fresh) > MOST:
            self.known.clear()
            fresh = range(len(keys))
        self.known.update(zip([keys[i] for i in fresh], self.candidates(kinds[list(fresh)]), strict=True))
        able = [self.known[k] for k in keys]
        found = [self._least(x[i : i + BLOCK], [able[j] for j in inverse[i : i + BLOCK].tolist()]) for i in range(0, len(x), BLOCK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _least(self, x: np.ndarray, able: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The exact nearest of each row's candidates."""
        n = np.array([len(a) for a in able])
        place, entry, at = np.repeat(np.arange(len(x)), n), np.concatenate(able), np.cumsum(n) - n
        kind = self._kind(x)
        far = _squares(x.astype(kind)[place] - self.book.astype(kind)[entry])
        least = np.minimum.reduceat(far, at)
        hits = np.flatnonzero(far == least[place])
        hits = hits[np.unique(place[hits], return_index=True)[1]]
        return entry[hits], least if kind is object else least.astype(np.int64)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1) if x.dtype == object else np.einsum("...i,...i->...", x, x)


_cells: dict[str, list[Cells]] = {}


def _books(books: list[np.ndarray]) -> list[Cells]:
    """The remembered cells of these codebooks, one for each part; those of former codebooks are forgotten."""
    name = hashlib.md5(b"".join(b.tobytes() for b in books)).hexdigest()
    if name not in _cells:
        _cells.clear()
        _cells[name] = [Cells(b) for b in books]
    return _cells[name]


def _assign(batch: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its vectors, the nearest entries and the distances; equal vectors are looked up once."""
    for part, cells in zip(np.split(batch, len(books), 1), _books(books), strict=True):
        kinds, inverse = np.unique(part, axis=0, return_inverse=True)
        entry, far = cells.nearest(kinds)
        yield part, entry[inverse], far[inverse]


def train(rows: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries by row) for each part of the vectors x of ``rows`` (id, x): first those of the smallest ids, then ``rounds`` times the
    floored means of the parts nearest to each entry.

    Entries that no part is nearest to stay. A round reads the vectors where they lie and shuffles a sum for each
    task and entry.
    """
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).collect()  # at most ENTRIES rows
    if not first:
        return []
    books = np.split(matrix(pa.array([r["x"] for r in first], pa.binary())), PARTS, 1)
    width = books[0].shape[1]

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums = {}
            for batch in batches:
                for p, (part, entry, _far) in enumerate(_assign(matrix(batch.column(0)), books)):
                    order = np.argsort(entry, kind="stable")
                    used, at, n = np.unique(entry[order], return_index=True, return_counts=True)
                    wide = part if len(part) * int(np.abs(part).max()) < LARGEST else part.astype(object)
                    for e, s, k in zip(used.tolist(), np.add.reduceat(wide[order], at), n.tolist(), strict=True):
                        old = sums.get((p, e), (0, 0))
                        sums[p, e] = (old[0] + s.astype(object), old[1] + k)
            if sums:
                keys = list(sums)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][1] for k in keys], pa.int64()), pa.array([[str(v) for v in sums[k][0]] for k in keys])], ["part", "entry", "n", "sums"])

        each = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<string>")
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        found = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # a row per entry
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def codes(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(``key``, ``label``, code, error) for each vector, and the codebooks.

    Entries c become integers floor(1024 c) (``vectors.integers`` says which rows are dropped; vectors whose length is
    no multiple of PARTS get zeros at the end, which changes no distance). code has two hex digits for each part's
    entry, error is the sum of the squared distances (null beyond 64 bits). Null and repeated keys stay, other
    columns are left out; with fewer than ENTRIES rows the codebooks have as many entries as there are rows, and an
    empty table gives none. Rows are never shuffled.
    """
    rows = cut(integers(vectors, column, SCALE, 0, [key, label], PARTS).withColumnRenamed(key, "id").withColumnRenamed(label, "label"))
    books = train(rows, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, far = zip(*[(e, f) for _part, e, f in _assign(matrix(batch.column(2)), books)], strict=True)
            flat = np.stack(entries, 1).astype(np.uint8).tobytes().hex()
            size = 2 * len(books)
            error = [v if v <= LARGEST else None for v in sum(f.astype(object) for f in far).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[i : i + size] for i in range(0, len(flat), size)]), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    types = dict(rows.dtypes)
    out = rows.select("id", "label", "x").mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long")
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error: the error summed over the rows of the same label, nulls together. Rows of frequent labels meet a broadcast."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit("")).alias("name")
    rows = cut(coded.select("*", name))
    sums = rows.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    return join_counted(rows, sums, ["name"], rows.count()).drop("name")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers in order, with commas between them."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
