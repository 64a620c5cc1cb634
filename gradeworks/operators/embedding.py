"""Chunks of long texts, and scores from their embedding vectors."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.functions.batches import parts
from gradeworks.functions.text import blank, cosine, truncate_to_tokens
from gradeworks.operators.calls import CallLog

KEY = ["sample_id", "model_id"]
#: A sentence ends after one of these marks and white space, or at a line feed.
BOUNDARY = re.compile(r"(?<=[.!?])\s+|\n", re.ASCII)


def pack_sentences(text: str, most: int, per_token: float) -> list[str]:
    """Chunks of at most ``most`` tokens: whole sentences as long as they fit; a longer one is cut by characters, alone."""
    size = lambda n: math.ceil(n / per_token)
    if size(len(text)) <= most:
        return [text]
    room, chunks, open_ = math.ceil(most * per_token), [], ""
    for s in filter(None, BOUNDARY.split(text)):
        whole = f"{open_} {s}" if open_ else s
        if size(len(s)) > most:
            chunks += [*([open_] if open_ else []), *(s[i : i + room] for i in range(0, len(s), room))]
            open_ = ""
        elif size(len(whole)) > most:
            chunks.append(open_)
            open_ = s
        else:
            open_ = whole
    return chunks + [open_] if open_ else chunks


def split_into_chunks(text: Column, most: int, per_token: float = 3.0) -> Column:
    """``pack_sentences`` of each text; an empty text is one empty chunk, null has none."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for lo, hi in parts((texts,)):
                yield pa.array([None if t is None else pack_sentences(t, most, per_token) for t in texts[lo:hi].to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def prepared(text: Column, strategy: str = "CHUNK", most: int = 512, per_token: float = 3.0) -> Column:
    """The pieces of a text to embed: chunks, the truncated text, or the text as it is (FAIL_FAST)."""
    if strategy == "CHUNK":
        return split_into_chunks(text, most, per_token)
    return F.array(truncate_to_tokens(text, most, per_token) if strategy == "TRUNCATE" else text)


def _sums(names: np.ndarray, vectors: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None], np.ndarray]:
    """First place, sum (None for unequal lengths) and count of each run of equal ``names``; vectors add up as whole arrays."""
    at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    n = np.add.reduceat(counts, at)
    if len({len(v) for v in vectors}) == 1:
        return at, list(np.add.reduceat(np.stack(vectors), at, axis=0)), n
    ends = [*at[1:].tolist(), len(names)]
    even = [len({len(v) for v in vectors[i:j]}) == 1 for i, j in zip(at.tolist(), ends, strict=True)]
    return at, [np.sum(vectors[i:j], axis=0) if e else None for i, j, e in zip(at.tolist(), ends, even, strict=True)], n


def average_embeddings(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, embedding: the mean of the vectors ``embedding`` of each key; null if their lengths differ or an entry is null. Null vectors don't count.

    Vectors are added as they are, first within each batch of a task, then, sorted by key, in a pass over partitions that
    holds one open key. So a key of very many vectors sends one sum per batch, and no row is made for a dimension.
    """
    name = F.to_json(F.struct(*keys)).alias("name")
    kinds = dict(chunks.dtypes)
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    k = len(keys)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        at = pc.fill_null(batch.column(k + 1).value_lengths(), 0).to_numpy(zero_copy_only=False)
        each = np.split(batch.column(k + 1).flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(at)[:-1])
        return batch.column(k).to_numpy(zero_copy_only=False), each, batch.column(k + 2).to_numpy()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                batch = batch.take(pc.sort_indices(batch.column(k)))
                at, sums, n = _sums(*arrays(batch))
                even = np.array([s is not None for s in sums])
                told = [pa.array(sums, pa.list_(pa.float64())), pa.array(n), pa.array(even)]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[: k + 1], *told], [*keys, "name", "embedding", "n", "even"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open key's name, columns, sum and count
        for batch in batches:
            if not batch.num_rows:
                continue
            names, vectors, counts = arrays(batch)
            uneven = set(names[~batch.column(k + 3).to_numpy(zero_copy_only=False)])
            at, sums, n = _sums(names, vectors, counts)
            made = [(names[i], None if names[i] in uneven else s, c) for i, s, c in zip(at.tolist(), sums, n.tolist(), strict=True)]
            columns = [c.take(pa.array(at)) for c in batch.columns[:k]]
            if held is not None:
                name, old, s, c = held
                if made[0][0] == name:
                    both = s is not None and made[0][1] is not None and len(s) == len(made[0][1])
                    made[0] = (name, s + made[0][1] if both else None, c + made[0][2])
                else:
                    made.insert(0, (name, s, c))
                    columns = [pa.concat_arrays([x, y]) for x, y in zip(old, columns, strict=True)]
            held = (made[-1][0], [c.slice(len(c) - 1) for c in columns], *made[-1][1:])
            yield out(made[:-1], [c.slice(0, len(c) - 1) for c in columns])
        if held is not None:
            yield out([(held[0], *held[2:])], held[1])

    def out(made: list, columns: list) -> pa.RecordBatch:
        means = [None if s is None or np.isnan(s).any() else s / c for _, s, c in made]
        return pa.RecordBatch.from_arrays([*columns, pa.array(means, pa.list_(pa.float64()))], [*keys, "embedding"])

    whole = F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("embedding")
    rows = chunks.where("embedding is not null").select(*keys, name, whole, F.lit(1).cast("long").alias("n"))
    some = rows.mapInArrow(partial, f"{own}, name string, embedding array<double>, n long, even boolean")
    return some.repartition("name").sortWithinPartitions("name").mapInArrow(final, f"{own}, embedding array<double>")


def embed(texts: DataFrame, log: CallLog, embedder: Callable, models: list[str]) -> DataFrame:
    """``texts`` (text and other columns) by model (model_id, model_pos) with ok, embedding, error and duration_ms.

    ``log`` is a ``vector_log``. Each distinct text is sent to a model once, in Arrow batches, however many rows
    have it; a failed call is a row that isn't ok.
    """
    return log.ask(texts, embedder, "text", models=models).drop("iteration")


def vector_log(spark: SparkSession, path: str) -> CallLog:
    """A log of embedding calls at ``path``."""
    return CallLog(spark, path, "embedding", "array<float>")


def semantic_similarity_of_texts(samples: DataFrame, log: CallLog, embedder: Callable, models: list[str], strategy: str = "CHUNK", most: int = 512, per_token: float = 3.0, threshold: float | None = None) -> DataFrame:
    """sample_id, model_id, score from the texts response and reference of ``samples``.

    Long texts are cut to chunks (CHUNK), shortened (TRUNCATE) or sent as they are (FAIL_FAST); a model of which any
    call for a sample failed has no row for it. Samples with a blank or null side have none, see
    ``outcomes.with_outcome``.
    """
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("whole")) for s in ("response", "reference")]))
    sides = samples.where(~blank(F.col("response")) & ~blank(F.col("reference"))).select("sample_id", side.alias("s")).select("sample_id", "s.*")
    pieces = sides.select("sample_id", "side", F.explode(prepared(F.col("whole"), strategy, most, per_token)).alias("text"))
    made = embed(pieces, log, embedder, models)
    # a null entry makes the mean null, so a failed call leaves its sample and model without a score
    return semantic_similarity(made.withColumn("embedding", F.when(F.col("ok"), F.col("embedding")).otherwise(F.array(F.lit(None).cast("float")))), threshold)


def response_relevancy_of_texts(samples: DataFrame, questions: DataFrame, log: CallLog, embedder: Callable, models: list[str]) -> DataFrame:
    """``response_relevancy`` of generated ``questions`` (sample_id, model_id, q_idx, question, noncommittal) and the texts user_input of ``samples``.

    An embedding model of which any call for a sample failed doesn't count for it. Blank questions aren't sent.
    """
    own = samples.where("user_input is not null").select("sample_id", F.lit(None).cast("string").alias("asker"), F.lit(-1).alias("q_idx"), F.col("user_input").alias("text"))
    made = questions.where(F.coalesce(F.trim("question"), F.lit("")) != "").select("sample_id", F.col("model_id").alias("asker"), F.col("q_idx").cast("int").alias("q_idx"), F.col("question").alias("text"))
    got = embed(own.unionByName(made), log, embedder, models)
    failed = got.where(~F.col("ok")).select("sample_id", "model_id").distinct()
    good = got.where("ok").join(failed, ["sample_id", "model_id"], "left_anti")
    vectors = good.select("sample_id", F.col("model_id").alias("embedding_model"), F.col("model_pos").alias("embedding_pos"), F.col("asker").alias("model_id"), "q_idx", "embedding")
    return response_relevancy(questions, vectors)


def semantic_similarity(vectors: DataFrame, threshold: float | None = None) -> DataFrame:
    """sample_id, model_id, score from chunk vectors (side response or reference, embedding): cosine of the sides' means.

    Models whose vectors don't fit together, or lack a side, have no row. With a threshold, 1 or 0.
    """
    mean = average_embeddings(vectors, [*KEY, "side"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("embedding")))
    both = mean.groupBy(*KEY).agg(side("response").alias("a"), side("reference").alias("b"))
    score = both.select(*KEY, cosine(F.col("a"), F.col("b")).alias("score")).where("score is not null")
    return score.withColumn("score", (F.col("score") >= threshold).cast("double")) if threshold and threshold > 0 else score


def response_relevancy(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """sample_id, model_id, score from each model's generated ``questions`` (q_idx, question, noncommittal).

    All noncommittal: 0; else the mean cosine of the user's input with each question that isn't blank.
    ``vectors`` (sample_id, embedding_model, embedding_pos, model_id, q_idx, embedding; q_idx -1 and no model:
    the user's input): of the embedding models that hold a sample's input, the first counts. Models without questions have no row.
    """
    first = vectors.where("q_idx = -1 and embedding is not null").groupBy("sample_id").agg(F.min_by(F.struct("embedding_model", F.col("embedding").alias("own")), "embedding_pos").alias("f")).select("sample_id", "f.*")
    own = vectors.where("q_idx >= 0").join(first, ["sample_id", "embedding_model"]).select(*KEY, "q_idx", cosine(F.col("own"), F.col("embedding")).alias("cos"))
    q = questions.withColumn("no", F.coalesce(F.col("noncommittal") == 1, F.lit(False))).withColumn("blank", F.coalesce(F.trim("question"), F.lit("")) == "")
    rows = q.join(own, [*KEY, "q_idx"], "left")
    mean = F.avg(F.when(~F.col("blank"), F.col("cos")))
    return rows.groupBy(*KEY).agg(F.when(F.min("no"), 0.0).otherwise(mean).alias("score"))
