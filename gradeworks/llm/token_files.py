"""Token ids as files of directly addressable codes: any token is read without decoding its block."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeworks.llm.common import cut, small
from gradeworks.llm.words import U, prefix_sums, slices, span_hash, split

#: Bits of an id on each level, and bits of a continuation bitmap for each entry of its rank directory.
CHUNK, STRIDE = 8, 64
#: Ids that a bucket of the directory of blocks spans.
BUCKET = 1 << 18
#: Bytes by kind: 1 a letter, 2 a digit or a mark that a tokenizer parts from letters; 0 any other.
KIND = np.array([1 if chr(b).isalpha() else 2 if 0x20 < b < 0x7F and chr(b) not in "'<|>" else 0 for b in range(128)] + [0] * 128, np.uint8)
#: What ends a piece where many are encoded in one call, and how many are.
MARK, TOGETHER = "\x01", 48
#: Words that a task remembers the ids of.
MOST_WORDS = 1 << 20
BLOCK = "part int, seq long, n long, own long, doc_ids binary, named binary, counts binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def encode_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels of chunks from the lowest bits up, continuation bitmaps, and set bits before every STRIDE bits."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> CHUNK
        more = rest > 0
        if not more.any():
            return levels, bitmaps, ranks
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), STRIDE))
        ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4").tobytes())
        rest = rest[more]


def decode_codes(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    out = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for low, bits in zip(levels[-2::-1], bitmaps[::-1], strict=True):
        low = np.frombuffer(low, np.uint8)
        more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(low), bitorder="little").astype(bool)
        full = low.astype(np.uint32)
        full[more] |= out << CHUNK
        out = full
    return out


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The tokens at places ``at`` of a block: one chunk a level for each, found by the rank directories."""
    at = np.asarray(at, np.int64)
    out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, low in enumerate(levels):
        out[open_] |= np.frombuffer(low, np.uint8)[at].astype(np.uint32) << np.uint32(CHUNK * k)
        if k == len(bitmaps):
            break
        words = np.frombuffer(bitmaps[k] + bytes(-len(bitmaps[k]) % 8), "<u8")[at // STRIDE]
        bit = (at % STRIDE).astype(U)
        more = ((words >> bit) & U(1)).astype(bool)
        before = np.bitwise_count(words & ((U(1) << bit) - U(1)))
        at = (np.frombuffer(ranks[k], "<u4")[at // STRIDE].astype(np.int64) + before)[more]
        open_ = open_[more]
    return out


class Encoder:
    """Ids of texts by a tokenizer that keeps no upper case, joins nothing over white space, nor a letter with a digit or mark.

    Texts are cut at such places and each piece's ids are computed once. Apostrophes (contractions) and the
    signs around special tokens are never cut off.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.end = Tokenizer.from_file(path), end
        mark = self._plain([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes = np.empty(0, U), np.empty(0, np.int64)
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has; many go in one call, a mark of its own token after each, unless a piece holds the mark."""
        if alone or self.mark is None:
            made = self._plain(pieces)
            return np.fromiter(chain.from_iterable(made), np.uint32), np.array([len(m) for m in made], np.int64)
        made = self._plain([f" {MARK} ".join([*pieces[i : i + TOGETHER], ""]) for i in range(0, len(pieces), TOGETHER)])
        every = np.fromiter(chain.from_iterable(made), np.uint32)
        marks = np.flatnonzero(every == self.mark)
        return every[every != self.mark], np.diff(marks, prepend=-1) - 1

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's, its end included."""
        if len(self.keys) > MOST_WORDS:
            self.clear()
        w = split(texts, lower=not any(b"<|" in t for t in texts if t))
        kind = KIND[w.buf]
        inside = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1  # a letter beside a digit or mark
        start, stop = (np.sort(np.concatenate((x, inside))) for x in (w.start, w.end))
        kinds, where, inverse = np.unique(span_hash(prefix_sums(w.buf), start, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, kinds)
        fresh = np.ones(len(kinds), bool)
        old = place < len(self.keys)
        fresh[old] = self.keys[place[old]] != kinds[old]
        if fresh.any():
            raw = w.buf.tobytes()
            pieces = [raw[a:b].decode() for a, b in zip(start[where[fresh]].tolist(), stop[where[fresh]].tolist(), strict=True)]
            ids, size = self._fresh(pieces, MARK.encode() in raw)
            self.keys = np.insert(self.keys, place[fresh], kinds[fresh])
            self.codes = np.insert(self.codes, place[fresh], len(self.at) - 1 + np.arange(len(pieces)))
            self.ids, self.at = np.concatenate((self.ids, ids)), np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        code = self.codes[np.searchsorted(self.keys, kinds)][inverse]
        ends = np.searchsorted(start, w.begin[1:])  # each text's end goes after its pieces
        first = np.insert(self.at[code], ends, len(self.ids))
        size = np.insert(self.at[code + 1] - self.at[code], ends, 1)
        before = np.cumsum(size) - size
        pool = np.append(self.ids, np.uint32(self.end))
        out = pool[np.repeat(first - before, size) + np.arange(size.sum())]
        closing = before[ends + np.arange(len(texts))] + 1
        return out, np.diff(closing, prepend=0)


def write_tokens(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order as a table of blocks, and return it as read back.

    Rows without doc_id come first; rows with the same id follow each other in the order of a hash of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = Encoder(tokenizer, end), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, counts = encode(texts[lo:hi])
                levels, bitmaps, ranks = encode_codes(ids)
                own = batch.column(0).slice(lo, hi - lo)
                one = [part, seq, len(ids), before, own.fill_null(0).to_numpy().astype("<i8").tobytes(), own.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), counts.astype("<i8").tobytes(), levels, bitmaps, ranks]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types, strict=True)], ["part", "seq", "n", "own", "doc_ids", "named", "counts", "levels", "bitmaps", "ranks"])
                seq, before = seq + 1, before + len(ids)

    return cut(rows.mapInArrow(run, BLOCK))


def _runs(counts: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` tokens."""
    cuts = np.unique(np.searchsorted(np.cumsum(counts), np.arange(most, int(counts.sum()) + most, most)) + 1)
    cuts = np.unique(np.minimum(np.concatenate(([0], cuts, [len(counts)])), len(counts)))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            counts = np.frombuffer(b["counts"], "<i8")
            first = np.cumsum(counts) - counts
            crc = []
            for lo, hi in _runs(counts):  # some documents at a time, by their tokens' places
                ids = access(b["levels"], b["bitmaps"], b["ranks"], np.arange(first[lo], first[hi - 1] + counts[hi - 1])).astype("<u4")
                crc += [zlib.crc32(ids[a : a + c]) for a, c in zip((first[lo:hi] - first[lo]).tolist(), counts[lo:hi].tolist(), strict=True)]
            named = np.frombuffer(b["named"], np.uint8) == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=named), pa.array(first + b["before"]), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``before``: the ids of all files before the block. A block knows those of its own file, so only a row per file is joined."""
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task that wrote
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    files = blocks.select("part").distinct().count()
    return blocks.join(small(base, files), "part").withColumn("before", F.col("base") + F.col("own")).drop("base", "own")


def token_table(blocks: DataFrame) -> DataFrame:
    """One row per text in the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    return _placed(blocks).select("doc_ids", "named", "counts", "levels", "bitmaps", "ranks", "before").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            at = np.array(b["at"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at + b["before"]), pa.array(access(b["levels"], b["bitmaps"], b["ranks"], at).astype(np.int64))], ["at", "token"])


def tokens_at(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """(at, token) for each distinct place ``at`` (long) among the ids of all files; null places and those outside are left out.

    The directory of blocks, not the blocks, meets the places: both are dealt by ranges of BUCKET ids, so a
    place meets only blocks of its range. Only blocks with a wanted place are read further.
    """
    place = _placed(blocks.select("part", "seq", "n", "own"))
    end = F.greatest(F.col("before") + F.col("n") - 1, F.col("before"))
    dealt = place.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("before") / BUCKET), F.floor(end / BUCKET))))
    want = places.select(F.col("at").cast("long").alias("at")).where("at >= 0").distinct().withColumn("bucket", F.floor(F.col("at") / BUCKET))
    hit = dealt.join(want, "bucket").where("at >= before and at < before + n").groupBy("part", "seq", "before").agg(F.collect_list(F.col("at") - F.col("before")).alias("at"))
    return blocks.select("part", "seq", "levels", "bitmaps", "ranks").join(hit, ["part", "seq"]).select("levels", "bitmaps", "ranks", "before", "at").mapInArrow(_pick, "at long, token long")


def token_output(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Encode, write and read back. Null and empty texts are their end id alone; repeated rows are written each; an empty table gives no rows."""
    return token_table(write_tokens(docs, tokenizer, end))
