"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import cut
from gradeworks.llm.words import LOWER, U, mix, prefix_sums, slices, span_hash

#: Bytes that end a word; those above 127 belong to letters.
BREAK = np.ones(256, bool)
BREAK[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
#: A sentence ends with one of these bytes.
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True
SPACES_IN_BYTES = frozenset((9, 10, 11, 12, 13, 32))
#: A word stands for itself and for its first bytes, so that unseen forms of a known stem count.
PREFIXES = (4, 5, 6)
#: Labelled documents of each class that the model is fitted on at most: those with the smallest hashes of doc_id.
MOST_ROWS = 6000
#: Sentences that score this much or more are reported.
OFFENDING = 0.3


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sentence (numbered within all texts) and 64-bit key of each feature of each word."""
    buf = np.frombuffer(b"".join(p for t in texts for p in (t or b"", b"\n")), np.uint8)
    begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    low = LOWER[buf]
    step = np.diff(np.concatenate(([0], ~BREAK[buf])).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = np.searchsorted(begin, start, side="right") - 1
    sentence = np.cumsum(STOP[buf])[start]
    sums = prefix_sums(low)
    out = [(row, sentence, mix(span_hash(sums, start, end) ^ U(1)))]
    for n in PREFIXES:
        long = end - start > n
        s = start[long]
        out.append((row[long], sentence[long], mix(span_hash(sums, s, s + n) ^ U(n))))
    r, s, h = (np.concatenate(c) for c in zip(*out, strict=True))
    return r, s, h


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each text."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            r, _, h = features(texts[lo:hi])
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.concatenate(([True], (np.diff(r) != 0) | (np.diff(h) != 0)))[: len(r)]
            at = np.searchsorted(r[new], np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[new].view(np.int64)))],
                ["toxic", "features"],
            )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weight of each feature, of the bias and the noisy-or's leak."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, leak: float) -> None:
        order = np.argsort(keys)
        self.keys, self.weights = keys[order].astype(U), weights[order]
        self.bias, self.leak = bias, leak
        self.maybe = np.zeros(1 << 20, bool)  # by the keys' low bits: most words need no search
        self.maybe[(self.keys & U((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the features ``h`` count, and their places among the keys."""
        at = np.flatnonzero(self.maybe[(h & U((1 << 20) - 1)).astype(np.int64)])
        x = np.searchsorted(self.keys, h[at])
        hit = x < len(self.keys)
        hit[hit] = self.keys[x[hit]] == h[at[hit]]
        return at[hit], x[hit]

    def sentences(self, r: np.ndarray, s: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and score of the sentences with a feature that counts."""
        hit, x = self.find(h)
        r, s, w = r[hit], s[hit], self.weights[x]
        if not len(s):
            return r, s, w
        kind, at, inv = np.unique(s, return_index=True, return_inverse=True)
        z = self.bias + np.bincount(inv, w)
        return r[at], kind, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(y: np.ndarray, row: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n: int, rounds: int = 250) -> tuple[np.ndarray, float, float]:
    """Maximum likelihood of document labels under noisy-or sentence scores, by Adam on the whole sample."""
    _, at, inv = np.unique(sentence, return_index=True, return_inverse=True)
    of = row[at]
    w, bias, leak = np.zeros(n + 1), -4.0, 0.01
    w[n] = bias
    m, v, rate = np.zeros(n + 1), np.zeros(n + 1), 0.1
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[n] + np.bincount(inv, w[feature], len(of)), -30, 30)))
        log_no = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + np.log(1 - leak)
        no = np.exp(log_no)
        # the loss is -log_no for a negative and -log(1 - no) for a positive; a sentence's score z moves log_no by -p
        d = np.where(y > 0, -no / np.maximum(1 - no, 1e-6), 1.0)[of] * p
        g = np.append(np.bincount(feature, d[inv], n), d.sum()) / len(y) + 1e-4 * np.append(w[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:n], float(w[n]), leak


def _training_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of the sample that the model is fitted on, and the sizes of the classes.

    Only ids and labels are shuffled, never texts. Held-out rows and null ids or labels are left out; of
    repeated labels the larger counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1)
    share = [int(min(1.0, MOST_ROWS / sizes.get(k, 1)) * 2**30) for k in (0, 1)]
    return known.where(order < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])), sizes


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside of the held-out quarter: about MOST_ROWS of each class.

    The sample's ids, about 2 * MOST_ROWS, are broadcast, so that no text is shuffled however many labels
    there are. A feature counts if it tells the classes apart by more than chance among all features of the
    sample (a likelihood ratio test at one false find in the whole sample). Without rows of both classes
    every score is the leak.
    """
    ids, sizes = _training_ids(docs, labels)
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.empty(0, U), np.empty(0), -4.0, 0.01)
    some = cut(docs.join(F.broadcast(ids), "doc_id").select("toxic", "text"))
    n = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(np.empty(0, U), np.empty(0), -4.0, 0.01)
    each = some.mapInArrow(_present, "toxic int, features array<long>").select("toxic", F.explode("features").alias("f"))
    counts = cut(each.groupBy("f").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")))
    pos, neg = F.col("pos") + 0.1, F.col("n") - F.col("pos") + 0.1
    gain = F.col("pos") * F.log(pos / n[1]) + (F.col("n") - F.col("pos")) * F.log(neg / n[0]) - F.col("n") * F.log((F.col("n") + 0.2) / (n[0] + n[1]))
    # twice the gain is chi-squared with one degree of freedom, whose tail beyond x is about exp(-x / 2) / sqrt(x)
    least = float(np.log(max(counts.count(), 2)))
    best = counts.where((F.col("n") >= 3) & (pos / n[1] > neg / n[0] * 2) & (gain >= least)).select("f").collect()
    keys = np.sort(np.array([r.f for r in best], np.int64).view(U))
    empty = Model(keys, np.ones(len(keys)), 0.0, 0.0)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                r, s, h = features(texts[lo:hi])
                hit, x = empty.find(h)
                r, s = r[hit], s[hit]
                o = np.lexsort((s, r))
                r, s, x = r[o], s[o], x[o]
                at = np.searchsorted(r, np.arange(hi - lo + 1))
                packed = [pa.array([c[a:e].astype(np.int32).tobytes() for a, e in zip(at[:-1], at[1:], strict=True)], pa.binary()) for c in (s, x)]
                yield pa.RecordBatch.from_arrays([pa.array(ys[lo:hi], pa.int32()), *packed], ["toxic", "sentence", "feature"])

    sample = some.mapInArrow(kept, "toxic int, sentence binary, feature binary").toArrow()
    y = sample.column(0).to_numpy()
    sent, feat = ([np.frombuffer(x, np.int32).astype(np.int64) for x in sample.column(c).to_pylist()] for c in (1, 2))
    row = np.repeat(np.arange(len(y)), [len(x) for x in sent])
    sentence = np.concatenate(sent) + row * (1 << 32)
    w, bias, leak = _fit(y, row, sentence, np.concatenate(feat), len(keys))
    return Model(keys, w, bias, leak)


def _spans(texts: list[bytes | None], row: np.ndarray, sentence: np.ndarray, p: np.ndarray) -> list[list[dict]]:
    """Of each text, start and end (code points) and score of its sentences that score OFFENDING or more."""
    out: list[list[dict]] = [[] for _ in texts]
    bad = np.flatnonzero(p >= OFFENDING)
    if not len(bad):
        return out
    buf = np.frombuffer(b"".join(q for t in texts for q in (t or b"", b"\n")), np.uint8)
    begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    stop = np.flatnonzero(STOP[buf])
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    for i in bad.tolist():
        r, k = int(row[i]), int(sentence[i])
        start = max(int(stop[k - 1]) + 1 if k else 0, int(begin[r]))
        end = min(int(stop[k]) + 1 if k < len(stop) else len(buf), int(begin[r + 1]) - 1)
        while start < end and buf[start] in SPACES_IN_BYTES:
            start += 1
        first = points[begin[r]]
        out[r].append({"start": int(points[start] - first), "end": int(points[end] - first), "score": float(p[i])})
    return out


SPAN = "array<struct<start:long,end:long,score:double>>"


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, offending.

    ``offending`` lists the sentences that score OFFENDING or more, in order, with start and end in code
    points. Only the text makes a score. Null and empty texts, and texts without a feature that counts,
    score the leak of the noisy-or. Repeated rows get the same score; null ids are carried through, not held
    out. Null labels and labels other than 0 and 1 are left out, of repeated ones the larger counts; with
    one class only, every row scores the leak. Empty tables: no rows, or the leak for every row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    model = train(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                r, s, h = features(texts[lo:hi])
                row, sentence, p = model.sentences(r, s, h)
                log_no = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), hi - lo) + np.log1p(-model.leak)
                spans = pa.array(_spans(texts[lo:hi], row, sentence, p), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.clip(-np.expm1(log_no), 0, 1)), spans], ["doc_id", "score", "offending"])

    scored = docs.mapInArrow(score, f"doc_id long, score double, offending {SPAN}")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "offending")
