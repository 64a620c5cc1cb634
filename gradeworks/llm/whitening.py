"""Whitening of embedding vectors: distinct vectors with their multiplicity carry the covariance, and each is whitened once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import cut, join_counted
from gradeworks.llm.vectors import integers, matrix

#: Integers per unit, and what is added so that they are positive.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are multiplied at a time, and tasks whose partial sums meet in one group.
ROWS, TOGETHER = 4096, 64
LARGEST = 2**63 - 1


def _wide(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` as Python's integers if results up to ``most`` may not fit 64 bits."""
    return x if most < 2**62 else x.astype(object)


def _totals(x: DataFrame) -> tuple[int, list[int]]:
    """The sum of the weights of (x, weight), and the weighted sum of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0
        for batch in batches:
            m, w = matrix(batch.column(0)), batch.column(1).to_numpy()
            n += int(w.sum())
            most = int(np.abs(m).max(initial=0)) * int(w.sum())
            s = s + (_wide(m, most) * w[:, None]).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(s))], pa.int32()), pa.array([str(v) for v in [n, *s]])], ["dim", "total"])

    each = x.select("x", "weight").mapInArrow(run, "dim int, total string")
    sums = {r["dim"]: int(r["total"]) for r in each.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}  # a row per dimension
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]


def _gram(table: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    """The weighted products of columns, summed over all rows that ``read`` makes of batches of ``table``.

    A task multiplies its rows in blocks and hands on one matrix, a row of it for each dimension; these meet
    in two levels, so no group holds more than TOGETHER times its share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for batch in batches:
            y, w = read(batch)
            for i in range(0, len(y), ROWS):
                part = y[i : i + ROWS]
                total += (part * w[i : i + ROWS, None]).T @ part
                some = True
        if some:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["dim", "task", "row"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "task": [key[-1]], "row": [sum(np.frombuffer(r) for r in rows["row"]).tobytes()]})

    schema = "dim int, task int, row binary"
    some = table.mapInArrow(run, schema).withColumn("task", F.floor(F.col("task") / TOGETHER).cast("int")).groupBy("dim", "task").applyInPandas(add, schema)
    rows = some.groupBy("dim").applyInPandas(add, schema).collect()  # a row per dimension
    out = np.zeros((d, d))
    for r in rows:
        out[r["dim"]] = np.frombuffer(r["row"])
    return (out + out.T) / 2


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """``key``, deviation, whitened (array, a number per component), and for the whole table n, explained (array) and identity_error.

    Entries c become integers floor(64 c) + 1,000,000 (``vectors.integers`` says which rows are dropped). Equal
    integer vectors are grouped, and their counts are the weights of the covariance, which divides by the number n of
    rows and is centred before multiplying. Components are its unit eigenvectors by falling eigenvalue, ``most`` at
    most; one whose eigenvalue is zero but for rounding has no whitened value and is left out, so a table of equal
    vectors gives rows with empty arrays. Each distinct vector is whitened once and joined back by a 128-bit digest;
    vectors that many rows have meet a broadcast. Null and repeated keys stay, other columns are left out, an
    empty table gives none. deviation is exact, or null beyond 64 bits.
    """
    x = integers(vectors, column, SCALE, SHIFT, [key]).withColumnRenamed(key, "id")
    kinds = cut(x.groupBy("x").agg(F.count("*").alias("weight")))
    n, sums = _totals(kinds)
    d = len(sums)

    def off(m: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exactly."""
        far = max(abs(n * int(m.max()) - min(sums)), abs(n * int(m.min()) - max(sums))) if len(m) else 0
        y = _wide(m, max(far * far * d, n * int(np.abs(m).max(initial=0)), *map(abs, sums)))
        return n * y - np.array(sums, y.dtype)

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return off(matrix(batch.column(0))).astype(float) / n, batch.column(1).to_numpy().astype(float)

    cov = _gram(kinds.select("x", "weight"), centred, d) / max(n, 1)
    values, axes = np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    real = values > d * np.finfo(float).eps * max(float(np.trace(cov)), 0.0)
    values, axes = values[real], axes[:, real]
    explained = (values / np.trace(cov)).tolist() if len(values) else []
    to = axes / np.sqrt(values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = off(matrix(batch.column(0)))
            far = [v if v <= LARGEST else None for v in (y * y).sum(1).tolist()]
            white = (y.astype(float) / n) @ to
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(values), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(far, pa.int64()), flat], ["digest", "weight", "deviation", "whitened"])

    digest = F.unhex(F.md5("x")).alias("digest")
    white = cut(kinds.select("x", digest, "weight").mapInArrow(apply, "digest binary, weight long, deviation long, whitened array<double>"))
    error = _identity_error(white, n, len(values))
    rows = join_counted(x.select("id", digest), white.withColumnRenamed("weight", "rows"), ["digest"], n)
    told = [F.lit(n).cast("long").alias("n"), F.lit(explained).cast("array<double>").alias("explained") if explained else F.array().cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error")]
    return rows.select(F.col("id").alias(key), "deviation", "whitened", *told)


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not n or not k:
        return 0.0
    mean = np.array(_means(white, n, k))

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = batch.column(0).flatten().to_numpy().reshape(-1, k) - mean
        return y, batch.column(1).to_numpy().astype(float)

    return float(np.abs(_gram(white.select("whitened", "weight"), centred, k) / n - np.eye(k)).max())


def _means(white: DataFrame, n: int, k: int) -> list[float]:
    sums = white.agg(*[F.sum(F.col("whitened")[i] * F.col("weight")).alias(f"s{i}") for i in range(k)]).first()
    return [s / n for s in sums]


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row per row of ``whitened`` and component (from 1): ``key``, component, n, deviation, whitened, explained, identity_error."""
    each = whitened.select(key, "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"), "identity_error")
    return each.select(key, (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
