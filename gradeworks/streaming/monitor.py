"""Live traffic: scores row by row, metrics by time window, conversations from messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.operators import overlap, similarity, verdicts
from gradeworks.sources.shared import new_folder


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet table at ``path``, a file or a folder, as a stream; ``files`` of them in a batch at most."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may also be a single file


def scored(pairs: DataFrame) -> DataFrame:
    """Each pair's ROUGE-1, without state: a stream gives a stream."""
    return overlap.rouge_n(pairs, 1)


#: The scores that need no judge, by metric.
DETERMINISTIC = {
    "rouge1": lambda p, keep: overlap.rouge_n(p, 1, keep=keep).withColumnRenamed("rouge", "score"),
    "rouge2": lambda p, keep: overlap.rouge_n(p, 2, keep=keep).withColumnRenamed("rouge", "score"),
    "bleu": lambda p, keep: overlap.bleu(p, keep=keep).withColumnRenamed("bleu", "score"),
    "chrf": lambda p, keep: overlap.chrf(p, keep=keep).withColumnRenamed("chrf", "score"),
    "rouge_l": lambda p, keep: p.select("sample_id", *keep, F.round(similarity.rouge_l(F.col("response"), F.col("reference")), 9).alias("score")),
    **{
        name: lambda p, keep, f=f: p.select("sample_id", *keep, F.round(f(F.col("response"), F.col("reference")), 9).alias("score"))
        for name, f in (("levenshtein", similarity.levenshtein_of_texts), ("hamming", similarity.hamming_similarity), ("jaro", similarity.jaro_similarity), ("jaro_winkler", similarity.jaro_winkler_similarity))
    },
    "groundedness": lambda p, keep: p.select("sample_id", *keep, F.round(verdicts.groundedness_shortcut(F.col("response"), F.array("reference")), 9).alias("score")),
}


def scores(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """sample_id, the other columns of ``pairs`` but its texts, metric, score: a row per pair and metric of DETERMINISTIC, without state.

    Each pair's texts pass through the metrics one after the other and are then dropped, so a stream is read once. A
    null score means that the metric says nothing: a side is missing, or for groundedness a judge is needed.
    """
    keep = tuple(c for c in pairs.columns if c not in ("sample_id", "metric", "score"))
    out, made = pairs.select("sample_id", *keep), []
    for m in metrics:
        out = DETERMINISTIC[m](out, (*keep, *made)).withColumnRenamed("score", f"_{m}")
        made.append(f"_{m}")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").cast("double").alias("score")) for m in metrics])).alias("s")
    rest = [c for c in keep if c not in ("response", "reference")]
    return out.select("sample_id", *rest, rows).select("sample_id", *rest, "s.metric", "s.score")


def score_alerts(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Scores (sample_id, metric, score) below their metric's limit, as they come."""
    return verdicts.alerts(scores, thresholds)


def windowed(scores: DataFrame, thresholds: dict[str, float], length: str, late: str, slide: str | None = None) -> DataFrame:
    """Mean score and number of alerts per metric and window of ``ts``; rows later than ``late`` are dropped.

    Null scores count as rows, but not in means or alerts.
    """
    below = F.coalesce(F.col("score") < verdicts._limit(thresholds), F.lit(False)).cast("long")
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = scores.withColumn("below", below).withWatermark("ts", late).groupBy(w.alias("w"), "metric")
    return rows.agg(F.avg("score").alias("mean"), F.sum("below").alias("n_alerts"), F.count("*").alias("n")).select("metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n_alerts", "n")


def conversations(messages: DataFrame, gap: str, late: str) -> DataFrame:
    """Messages (conv_id, ts, role, content) of a conversation with no pause of ``gap`` or more: start, end, turns in order of time."""
    turn = F.struct("ts", "role", "content")
    rows = messages.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "conv_id")
    return rows.agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there and read what it has written; it starts again where it stopped."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
