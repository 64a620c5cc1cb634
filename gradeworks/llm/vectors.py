"""Whole numbers made of embedding vectors, shared by the operators on ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers are kept within this many bits; larger ones saturate.
BITS = 62


def integers(vectors: DataFrame, column: str, scale: int, shift: int, keep: list[str], multiple: int = 1) -> DataFrame:
    """``keep`` and x: floor(scale * c) + shift of each entry c, as little-endian 64-bit integers, zeros up to a whole ``multiple`` of entries.

    Rows are dropped whose vector is null, empty, or holds null or non-finite entries, or has another length than
    most rows have (of equally frequent lengths, the shortest).
    """
    rows = vectors.select(*[F.col(f"`{k}`").alias(k) for k in keep], F.col(f"`{column}`").cast("array<double>").alias("x"))
    rows = rows.where(F.size("x") > 0).where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = usual["d"] if usual else 0
    pad = -d % multiple

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.floor(scale * pc.list_flatten(batch.column(len(keep))).to_numpy(zero_copy_only=False).reshape(-1, d))
            x = np.clip(made, -(2.0**BITS), 2.0**BITS).astype("<i8") + shift
            x = np.pad(x, ((0, 0), (0, pad)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (d + pad)), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())], [*keep, "x"])

    types = dict(rows.dtypes)
    return rows.where(F.size("x") == d).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "x binary"]))


def matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equally long vectors of 64-bit integers, a row each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<i8").reshape(len(column), -1)
