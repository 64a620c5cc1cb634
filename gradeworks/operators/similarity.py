"""Similarities of two strings; null if a side is null or empty."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.functions.batches import parts, points, tokens


def _both(a: Column, b: Column, score: Column) -> Column:
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.when(a == b, F.lit(1.0)).otherwise(score))


def levenshtein_similarity(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """By the built-in distance, whose time grows with the product of the lengths; ``levenshtein_of_texts`` is for whole documents."""
    a, b = (a, b) if case_sensitive else (F.lower(a), F.lower(b))
    return _both(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def levenshtein(a: str, b: str, most: int | None = None) -> int | None:
    """Edit distance, a bit for each character of the shorter text; None as soon as it must exceed ``most``."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if most is not None and len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    equal = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    m = len(a)
    full, top = (1 << m) - 1, m - 1
    up, down, far = full, 0, m  # where the next row's cell is one more, or less, than this one's
    for i, c in enumerate(b):
        eq = equal.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(across | up)), up & across
        far += (more >> top & 1) - (less >> top & 1)
        if most is not None and far - (len(b) - i - 1) > most:
            return None
        more, less = (more << 1 | 1) & full, less << 1 & full
        diagonal = eq | down
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return far


def levenshtein_of_texts(a: Column, b: Column, case_sensitive: bool = False, least: float = 0.0) -> Column:
    """``levenshtein_similarity`` of long texts, bit-parallel; null for a similarity below ``least``, which ends the work early."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            n = max(len(s), len(t)) if s and t else 0
            d = levenshtein(s, t, math.floor(n * (1 - least) + 1e-9)) if n else None
            out.append(None if d is None else 1 - d / n)
        return pd.Series(out, dtype="float64")

    return run(*((a, b) if case_sensitive else (F.lower(a), F.lower(b))))


def hamming_similarity(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """The shorter string is padded with spaces on the right. Both are split once."""
    a, b = (a, b) if case_sensitive else (F.lower(a), F.lower(b))
    n = F.greatest(F.length(a), F.length(b))
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x, F.lit(" ")) != F.coalesce(y, F.lit(" ")))
    return _both(a, b, 1 - F.size(F.filter(differ, lambda x: x)) / n)


def _matches(s: str, t: str, reach: int) -> tuple[str, str]:
    """Characters of ``s`` and of ``t`` that match, each in its order: the earliest free one within ``reach``.

    The window only moves on, so each character's places in ``t`` are passed once.
    """
    places: dict[str, list[int]] = {}
    for j, c in enumerate(t):
        places.setdefault(c, []).append(j)
    at, free, left = dict.fromkeys(places, 0), bytearray(b"\1") * len(t), []
    for i, c in enumerate(s):
        own = places.get(c)
        if own:
            k = at[c]
            while k < len(own) and own[k] < i - reach:
                k += 1
            if k < len(own) and own[k] <= i + reach:
                free[own[k]] = 0
                left.append(c)
                k += 1
            at[c] = k
    return "".join(left), "".join(c for c, f in zip(t, free, strict=True) if not f)


def jaro(s: str, t: str) -> float:
    if s == t:
        return 1.0
    x, y = _matches(s, t, max(0, max(len(s), len(t)) // 2 - 1))
    m = len(x)
    swaps = sum(p != q for p, q in zip(x, y, strict=True)) // 2
    return (m / len(s) + m / len(t) + (m - swaps) / m) / 3 if m else 0.0


def jaro_winkler(s: str, t: str) -> float:
    """Matches are sought from the shorter string, half transpositions count, and a common prefix lifts scores of 0.7 and more."""
    short, long = (s, t) if len(s) <= len(t) else (t, s)
    x, y = _matches(short, long, max(0, len(long) // 2 - 1))
    m = len(x)
    if not m:
        return 0.0
    score = (m / len(s) + m / len(t) + (m - sum(p != q for p, q in zip(x, y, strict=True)) / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(short)) and short[prefix] == long[prefix]:
        prefix += 1
    return score if score < 0.7 else score + 0.1 * prefix * (1 - score)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, a bit for each token of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro_similarity(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return _pairwise(jaro)(*((a, b) if case_sensitive else (F.lower(a), F.lower(b))))


def jaro_winkler_similarity(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return _pairwise(jaro_winkler)(*((a, b) if case_sensitive else (F.lower(a), F.lower(b))))


def _lcs(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Common subsequence and numbers of tokens of lower-cased texts."""
    for a, b in columns:
        for lo, hi in parts((a, b)):
            both = [x or "" for pair in zip(a[lo:hi].to_pylist(), b[lo:hi].to_pylist(), strict=True) for x in pair]
            hashed, n = tokens(*points(both))
            own = np.split(hashed, np.cumsum(n)[:-1])
            common = np.array([lcs_length(x.tolist(), y.tolist()) for x, y in zip(own[::2], own[1::2], strict=True)], np.int64)
            yield pa.StructArray.from_arrays([pa.array(common), pa.array(n[::2]), pa.array(n[1::2])], ["lcs", "a", "b"])


def rouge_l(response: Column, reference: Column, mode: str = "FMEASURE") -> Column:
    """By the longest common subsequence of tokens; 0 if a side has no token."""
    c = F.arrow_udf(_lcs, "struct<lcs:long,a:long,b:long>")(F.lower(response), F.lower(reference))
    n = c["lcs"]
    p, r = n / c["a"], n / c["b"]
    value = {"PRECISION": p, "RECALL": r, "FMEASURE": F.when(n == 0, 0.0).otherwise(2 * p * r / (p + r))}[mode]
    return F.when((F.length(response) > 0) & (F.length(reference) > 0), F.when((c["a"] == 0) | (c["b"] == 0), 0.0).otherwise(value))
