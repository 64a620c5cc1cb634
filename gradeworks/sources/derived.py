"""Inputs of the evaluation queries, derived from the given tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("m0", "m1", "m2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer tasks than those; else as it is, so large inputs are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return texts.select(F.col("doc_id").alias("sample_id"), "lang", F.split("text", " ").alias("w"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each document's words as response, the second as reference."""
    d = _words(spark, sf_dir)
    h = F.floor(F.size("w") / 2).cast("int")
    d = d.where("w is not null").select("sample_id", "lang", F.array_join(F.slice("w", 1, F.size("w") - h), " ").alias("response"), F.array_join(F.slice("w", F.size("w") - h + 1, F.size("w")), " ").alias("reference"))
    return d.where("response <> '' and reference <> ''")


def whole_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its last quarter of words as response, without its first quarter as reference."""
    d = _words(spark, sf_dir)
    q = F.floor(F.size("w") / 4).cast("int")
    d = d.where("w is not null").select("sample_id", "lang", F.array_join(F.slice("w", 1, F.size("w") - q), " ").alias("response"), F.array_join(F.slice("w", q + 1, F.size("w")), " ").alias("reference"))
    return d.where("response <> '' and reference <> ''")


def judged(spark: SparkSession, sf_dir: str, items: int = 5) -> DataFrame:
    """sample_id, model_id, pos, idx for each document, model and item; calls that failed are left out."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    m = F.explode(F.array(*[F.struct(F.lit(k).alias("model_id"), F.lit(i).alias("pos")) for i, k in enumerate(MODELS)])).alias("m")
    rows = ids.select("sample_id", m).select("sample_id", "m.model_id", "m.pos").where((F.col("sample_id") * 17 + F.col("pos") * 5) % 11 != 0)
    return rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))


def verdict(shift: int = 0):
    return (F.col("sample_id") * 31 + F.col("idx") * 7 + F.col("pos") * 13 + shift) % 5 < 3


def scores_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir, 1)
    return rows.select("sample_id", "model_id", ((F.col("sample_id") * 13 + F.col("pos") * 29) % 101 / 100).alias("score"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as tool calls: even ids were made, odd ids expected."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    k = F.get_json_object("props", "$.k").cast("long") % 3
    return e.select((F.col("user_id") * 1000 + day).alias("sample_id"), F.when(F.col("event_id") % 2 == 0, "actual").otherwise("reference").alias("side"), F.col("event_type").alias("name"), F.concat(F.lit("k="), k.cast("string")).alias("args"))
