"""Scores of a response against a reference by shared n-grams. Tables ``pairs`` have sample_id, response, reference.

Grams are counted inside the row, on Arrow batches, so nothing is exploded or shuffled: a batch is taken in parts of
``batches.SLICE`` bytes, all texts of a part are one array, and a sort per order counts the grams of both sides. So
beside the batch itself a task holds the arrays of one part only.
A null or empty side gives a null score; rows that repeat a sample_id are scored each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.batches import U, mix, parts, points, tokens

COUNTS = "array<struct<n:int,overlap:long,resp_total:long,ref_total:long>>"


def count_grams(codes: np.ndarray, sizes: np.ndarray, orders: list[int]) -> np.ndarray:
    """Overlap and totals of each row and order; ``codes`` holds response and reference of one row after another, of ``sizes`` codes each.

    A gram is its row, 51 bits of a hash, and its side, so that one sort brings the equal grams of a row together,
    those of the response right before those of the reference.
    """
    rows = len(sizes) // 2
    owner = np.repeat(np.arange(len(sizes), dtype=U), sizes)
    top = ((owner >> U(1)) << U(52)) | (owner & U(1))
    out = np.zeros((rows, len(orders), 3), np.int64)
    h, value = np.zeros(len(codes), U), mix(codes.astype(U) + U(0x9E3779B97F4A7C15))
    for n in range(1, max(orders) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] + value[n - 1 : n - 1 + m])
        if n not in orders:
            continue
        key = ((h >> U(13)) << U(1)) | top[:m]
        key = np.sort(key if n == 1 else key[top[:m] == top[n - 1 : n - 1 + m]])
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run, times = key[first], np.diff(first, append=len(key))
        both = np.flatnonzero((run[1:] ^ run[:-1]) == U(1))
        shared = np.minimum(times[both], times[both + 1])
        total = np.maximum(sizes - n + 1, 0)
        at = orders.index(n)
        out[:, at, 0] = np.bincount((run[both] >> U(52)).astype(np.int64), shared, rows).astype(np.int64)
        out[:, at, 1], out[:, at, 2] = total[::2], total[1::2]
    return out


def _array(counts: np.ndarray, orders: list[int]) -> pa.Array:
    n = pa.array(np.tile(np.array(orders, np.int32), len(counts)))
    each = pa.StructArray.from_arrays([n, *[pa.array(counts[:, :, k].ravel()) for k in range(3)]], ["n", "overlap", "resp_total", "ref_total"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * len(orders)), each)


def _counter(orders: dict[str, list[int]]):
    """Counts by kind (char, word) of lower-cased texts, all kinds from one pass."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in columns:
            for lo, hi in parts((a, b)):
                both = [x or "" for pair in zip(a[lo:hi].to_pylist(), b[lo:hi].to_pylist(), strict=True) for x in pair]
                codes, sizes = points(both)
                made = [_array(count_grams(*((codes, sizes) if kind == "char" else tokens(codes, sizes)), own), own) for kind, own in orders.items()]
                yield pa.StructArray.from_arrays(made, list(orders))

    return F.arrow_udf(run, "struct<" + ",".join(f"{kind}:{COUNTS}" for kind in orders) + ">")


def overlap_counts(response: Column, reference: Column, orders: list[int], kind: str = "word") -> Column:
    """One struct (n, overlap, resp_total, ref_total) per order; overlap sums the smaller counts of each gram."""
    return _counter({kind: orders})(F.lower(response), F.lower(reference))[kind]


def _given() -> Column:
    return (F.length("response") > 0) & (F.length("reference") > 0)


def ngram_overlap(pairs: DataFrame, orders: list[int], kind: str = "word") -> DataFrame:
    """sample_id, n, overlap, resp_total, ref_total, for samples with both texts."""
    counts = overlap_counts(F.col("response"), F.col("reference"), orders, kind)
    return pairs.where(_given()).select("sample_id", counts.alias("c")).select("sample_id", F.inline("c"))


def _harmonic(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(p + r == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def _counts(pairs: DataFrame, orders: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    return pairs.select("sample_id", *keep, overlap_counts(F.col("response"), F.col("reference"), orders).alias("c"), _given().alias("given"))


def _scored(counts: DataFrame, score: Column, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return counts.select("sample_id", *keep, F.round(F.when(F.col("given"), score), 9).alias(name))


def bleu(pairs: DataFrame, max_ngram: int = 4, smoothing: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """BLEU with add-one smoothing of every order and brevity penalty, beside the columns ``keep``; 0 if a side has no token."""
    c = _counts(pairs, list(range(1, max_ngram + 1)), keep)
    n, m = F.get("c", F.lit(0))["resp_total"], F.get("c", F.lit(0))["ref_total"]
    if smoothing:
        p = lambda o: F.when(o["resp_total"] == 0, 1 / (n + 1)).otherwise((o["overlap"] + 1) / (o["resp_total"] + 1))
    else:
        p = lambda o: F.when(o["resp_total"] == 0, F.lit(0.0)).otherwise(o["overlap"] / o["resp_total"])
    ps = c.withColumn("ps", F.transform("c", p))
    logs = F.aggregate(F.filter("ps", lambda x: x > 0), F.lit(0.0), lambda s, x: s + F.log(x))
    penalty = F.when(n >= m, 1.0).otherwise(F.exp(1 - m / n))
    score = F.when((n == 0) | (m == 0) | ~F.exists("ps", lambda x: x > 0), 0.0).otherwise(F.least(F.lit(1.0), F.exp(logs / max_ngram) * penalty))
    return _scored(ps, score, "bleu", keep)


def rouge_n(pairs: DataFrame, n: int = 1, mode: str = "FMEASURE", keep: tuple[str, ...] = ()) -> DataFrame:
    """ROUGE-N, beside the columns ``keep``; 0 if a side has no token, 1 if neither has n of them."""
    orders = [1, n] if n > 1 else [1]
    one, o = F.get("c", F.lit(0)), F.get("c", F.lit(len(orders) - 1))
    p, r = o["overlap"] / o["resp_total"], o["overlap"] / o["ref_total"]
    value = {"PRECISION": p, "RECALL": r, "FMEASURE": _harmonic(p, r)}[mode]
    score = F.when((one["resp_total"] == 0) | (one["ref_total"] == 0), 0.0).when((o["resp_total"] == 0) & (o["ref_total"] == 0), 1.0)
    return _scored(_counts(pairs, orders, keep), score.when((o["resp_total"] == 0) | (o["ref_total"] == 0), 0.0).otherwise(value), "rouge", keep)


def _mean_f(counts: str, beta: float) -> Column:
    """Mean F-beta over orders: 1 where neither side has a gram, 0 where one has none."""

    def f(o: Column) -> Column:
        none = (o["resp_total"] == 0).cast("int") + (o["ref_total"] == 0).cast("int")
        return F.when(none == 2, 1.0).when(none == 1, 0.0).otherwise(_harmonic(o["overlap"] / o["resp_total"], o["overlap"] / o["ref_total"], beta))

    return F.aggregate(F.transform(counts, f), F.lit(0.0), lambda s, x: s + x) / F.size(counts)


def chrf(pairs: DataFrame, char_order: int = 6, word_order: int = 0, beta: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean F-beta over character n-grams; with word orders, the mean of that and of the word n-grams' mean."""
    orders = {"char": list(range(1, char_order + 1))} | ({"word": list(range(1, word_order + 1))} if word_order else {})
    counts = _counter(orders)(F.lower("response"), F.lower("reference"))
    c = pairs.select("sample_id", *keep, _given().alias("given"), counts.alias("k"))
    c = c.select("sample_id", *keep, "given", F.col("k.char").alias("c"), *([F.col("k.word").alias("w")] if word_order else []))
    return _scored(c, (_mean_f("c", beta) + _mean_f("w", beta)) / 2 if word_order else _mean_f("c", beta), "chrf", keep)
