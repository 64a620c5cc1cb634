"""Tables for reports: step statistics, times, timelines, score entries, one row per evaluation.

``results`` tables have a row per call: sample_id, metric, step_name, step_index, step_type, model_id,
model_pos, iteration, ok, duration_ms. Missing durations count as 0, a null ok as a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = ["sample_id", "metric", "step_index", "step_name"]


def step_stats(results: DataFrame) -> DataFrame:
    """Of each step: successes, failures, share of successes, and its duration, that of its slowest call."""
    ok = F.coalesce("ok", F.lit(False)).cast("long")
    return results.groupBy(*STEP).agg(F.sum(ok).alias("n_ok"), F.sum(1 - ok).alias("n_failed"), F.avg(ok).alias("success_rate"), F.max(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"))


def model_time_totals(results: DataFrame) -> DataFrame:
    """Of each sample and metric: the largest sum of a model's calls (LLM steps), and the largest embedding call."""
    per = results.where("duration_ms is not null").groupBy("sample_id", "metric", "model_id").agg(*[f(F.when(F.col("step_type") == t, F.col("duration_ms"))).alias(t) for f, t in ((F.sum, "LLM"), (F.max, "EMBEDDING"))])
    return per.groupBy("sample_id", "metric").agg(F.coalesce(F.max("LLM"), F.lit(0)).alias("llm_ms"), F.coalesce(F.max("EMBEDDING"), F.lit(0)).alias("embedding_ms"))


def timeline(results: DataFrame) -> DataFrame:
    """Each call with its start and end: steps follow each other, a step starts when the slowest call of the one before ends.

    label: the model, with the number of the call if it has several in the step.
    """
    own = Window.partitionBy("sample_id", "metric").orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    start = step_stats(results).select(*STEP, F.coalesce(F.sum("duration_ms").over(own), F.lit(0)).alias("start_ms"))
    same = Window.partitionBy(*STEP, "model_id")
    rows = results.withColumn("nth", F.row_number().over(same.orderBy("iteration"))).withColumn("many", F.count("*").over(same))
    label = F.when(F.col("many") > 1, F.concat("model_id", F.lit(" (iter "), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("model_id"))
    ms = F.coalesce("duration_ms", F.lit(0))
    return rows.join(start, STEP).select(*STEP, label.alias("label"), F.coalesce("ok", F.lit(False)).alias("ok"), "start_ms", (F.col("start_ms") + ms).alias("end_ms"))


def score_entries(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """Model scores, and excluded models (sample_id, metric, model_id) with 0 and a flag."""
    out = scores.select("sample_id", "metric", "model_id", "score", F.lit(False).alias("excluded"))
    gone = excluded.select("sample_id", "metric", "model_id").distinct()
    return out.unionByName(gone.select("*", F.lit(0.0).alias("score"), F.lit(True).alias("excluded")))


def evaluation_result(scores: DataFrame, results: DataFrame) -> DataFrame:
    """One row per sample and metric: mean score (null if no model scored), scores by model, excluded models, duration over steps."""
    by = ["sample_id", "metric"]
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", "score"))))
    scored = scores.where("score is not null").groupBy(*by).agg(F.avg("score").alias("score"), entries.alias("model_scores"))
    failed = F.when(~F.coalesce("ok", F.lit(False)), F.col("model_id"))
    gone = results.groupBy(*by).agg(F.array_sort(F.collect_set(failed)).alias("excluded"))
    took = step_stats(results).groupBy(*by).agg(F.sum("duration_ms").alias("duration_ms"))
    return took.join(gone, by).join(scored, by, "left").select(*by, "score", "model_scores", "excluded", "duration_ms")


def verdict_items(items: DataFrame, idx: str, passed: str) -> DataFrame:
    """Items of verdict tables for drill-down: sample_id, model_id, item (from 1), passed (null is false)."""
    return items.select("sample_id", "model_id", (F.col(idx) + 1).cast("long").alias("item"), F.coalesce(F.expr(passed), F.lit(False)).alias("passed"))
