"""Passages that occur elsewhere, by a relative Lempel-Ziv parse against the indexed blocks of all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.batches import parts
from gradeworks.llm.common import cut, join_counted
from gradeworks.llm.words import U, mix, ngrams, powers, split

#: Words in a seed of the index.
SEED = 6


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, U)
    np.cumsum((h | U(1)) * powers(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def blocks_of(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Blocks of the texts whose word hashes stand in h: seed, hash, row, first and last window start.

    Of the seeds in a window of ``size`` words the least stands for the window, so equal windows have equal
    seeds at equal places. Windows in a row with the same seed are a block.
    """
    n = len(h) - size + 1
    if n <= 0:
        return (np.empty(0, U), np.empty(0, U), *[np.empty(0, np.int64)] * 3)
    g = ngrams(h, SEED)
    width = size - SEED + 1
    value, at, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        m = len(value) - step
        right = value[step : step + m] < value[:m]
        value, at = np.where(right, value[step : step + m], value[:m]), np.where(right, at[step : step + m], at[:m])
        have += step
    start = np.flatnonzero(row[:n] == row[size - 1 : size - 1 + n])
    if not len(start):
        return (np.empty(0, U), np.empty(0, U), *[np.empty(0, np.int64)] * 3)
    seed = at[start]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(seed) != 0) | (np.diff(start) != 1))))
    first, last = start[head], start[np.concatenate((head[1:], [len(start)])) - 1]
    at = seed[head]
    block = mix(_hash(_sums(h), first, last + size) ^ mix((at - first).astype(U) + (last - first).astype(U) * U(1 << 20)))
    return g[at], block, row[first], first, last


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in parts((texts,)):
                w = split(texts[lo:hi].to_pylist())
                seed, block, row, first, last = blocks_of(w.hash, w.row, size)
                base = w.first[row]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(seed.view(np.int64)), pa.array(block.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["id", "h", "seed", "block", "lo", "hi"])

    return run


def _windows(size: int):
    """Hash of each window of the blocks that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts((batch.column(2),)):
                w, open_ = split(batch.column(2)[a:b].to_pylist()), batch.column(3)[a:b].to_pylist()
                rows = [(i, x["seed"], w.first[i] + x["lo"], w.first[i] + x["hi"], x["weight"]) for i in range(b - a) for x in open_[i]]
                i, seed, lo, hi, weight = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
                n = hi - lo + 1
                start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.repeat(i, n)
                take = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(seed, n)), pa.array(_hash(_sums(w.hash), start, start + size).view(np.int64)), pa.array((start - w.first[of]).astype(np.int32)), pa.array(np.repeat(weight, n).astype(np.int32))], ["id", "h", "seed", "window", "at", "weight"])

    return run


def parse(blocks: list[dict], size: int) -> list[dict]:
    """Greedy factors of a document, given its blocks that the reference has, each with its first place there.

    From the first block that no factor covers, a factor takes every block that follows in the document as
    well as at the factor's place in the reference. Words start to end of the document are those from
    ref_start on of document ref.
    """
    out: list[dict] = []
    for b in sorted(blocks, key=lambda b: b["lo"]):
        r, shift = b["ref"], b["ref"]["lo"] - b["lo"]
        last = out[-1] if out else None
        if last and last["h"] == r["h"] and last["ref_start"] - last["start"] == shift and b["lo"] <= last["end"] - size + 1:
            last["end"] = max(last["end"], b["hi"] + size)
        else:
            out.append({"start": b["lo"], "end": b["hi"] + size, "h": r["h"], "ref": r["id"], "ref_start": r["lo"]})
    return out


FACTOR = "array<struct<start:long,end:long,ref:long,ref_start:long>>"
_FACTOR = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "ref", "ref_start")]))


def _without(size: int):
    """Of each text, its factors and the words that neither they nor windows at their boundaries cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts((batch.column(1),)):
                texts, blocks, ends = (batch.column(c)[a:b].to_pylist() for c in (1, 2, 3))
                kept, total, gone, merged, parsed = [], [], [], [], []
                w = split(texts)
                for i in range(b - a):
                    start, end = w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]]
                    t, first = texts[i] or b"", w.begin[i]
                    step = np.zeros(len(start) + 1, np.int64)
                    factors = parse(blocks[i] or [], size)
                    at = np.array([(f["start"], f["end"]) for f in factors] + [(x, x + size) for x in ends[i] or ()], np.int64).reshape(-1, 2)
                    np.add.at(step, at[:, 0], 1)
                    np.add.at(step, at[:, 1], -1)
                    out = np.cumsum(step[:-1]) > 0
                    edge = np.diff(np.concatenate(([0], out.astype(np.int8), [0])))
                    merged.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    kept.append(b" ".join([t[s:e] for s, e in zip((start[~out] - first).tolist(), (end[~out] - first).tolist(), strict=True)]).decode())
                    total.append(len(start))
                    gone.append(int(out.sum()))
                    parsed.append([{k: f[k] for k in ("start", "end", "ref", "ref_start")} for f in factors])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(parsed, _FACTOR)],
                    ["doc_id", "text", "n_words", "n_removed", "spans", "factors"],
                )

    return run


def without_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """Each row of ``docs`` without the words of windows of ``size`` words that also start elsewhere.

    Rows: doc_id, text (kept words joined by a space), n_words, n_removed, spans (removed words, start and
    end), factors. A relative Lempel-Ziv parse finds them. All documents are cut into blocks, one for each
    run of windows with the same least seed, so that equal passages are cut at equal words; every distinct
    block, at its first place, is part of the reference and indexed under its seed. Each document is then
    factored greedily against the blocks that occur more than once (``parse``): a factor runs on as long as
    the reference does at its place. Every factor has at least ``size`` words, so it is a duplicate span.
    Where a factor ends, the seed goes on with different blocks elsewhere: windows of such boundary blocks are
    compared one by one, with those of one block of each kind. So every window is judged, but only those at
    boundaries travel. A block's place is its first one, so a factor may end where another place would have
    gone on; the words covered are the same.

    Null and empty texts have no words; texts shorter than ``size`` lose none; rows that repeat whole texts
    are places of their own, so both lose all their windows. Rows are told apart by doc_id and a hash of the
    text; null ids are carried through. Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).select("id", F.xxhash64("id", "text").alias("h"), "text")
    blocks = cut(docs.mapInArrow(_blocks(size), "id long, h long, seed long, block long, lo int, hi int"))
    kinds = cut(blocks.groupBy("seed", "block").agg(F.count("*").alias("n"), F.min(F.struct("h", "lo", "id")).alias("ref")))
    shared = kinds.groupBy("seed").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("all > 1").select("seed", "rows", F.col("rows").alias("kinds"))
    index = cut(join_counted(kinds, shared, ["seed"], kinds.count()).withColumnRenamed("n", "rows").withColumn("n", F.col("rows")))
    placed = cut(join_counted(blocks, index, ["seed", "block"], blocks.count()))
    whole = placed.where("n > 1").groupBy("h").agg(F.collect_set(F.struct("lo", "hi", "ref")).alias("blocks"))
    lead = F.struct("h", "lo") == F.struct("ref.h", "ref.lo")
    edge = placed.where(F.col("kinds") > 1).where((F.col("n") == 1) | lead)
    todo = edge.groupBy("h").agg(F.collect_list(F.struct("seed", "lo", "hi", F.when(F.col("n") == 1, 1).otherwise(2).alias("weight"))).alias("open"))
    windows = cut(docs.join(todo, "h").select("id", "h", "text", "open").mapInArrow(_windows(size), "id long, h long, seed long, window long, at int, weight int"))
    twice = windows.groupBy("seed", "window").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("weight") == 1, 1).otherwise(0)).alias("rows")).where("n > 1").select("seed", "window", "rows")
    single = windows.where("weight = 1")
    single = join_counted(single, twice, ["seed", "window"], single.count()).groupBy("h").agg(F.collect_set("at").alias("ends"))
    found = whole.join(single, "h", "full_outer")
    return docs.join(found, "h", "left").select("id", "text", "blocks", "ends").mapInArrow(_without(size), f"doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, factors {FACTOR}")
