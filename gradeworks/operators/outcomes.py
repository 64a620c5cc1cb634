"""One outcome policy for all metrics: a score comes with a status.

OK, SKIPPED (the input lacks what the metric needs, score null), ZERO_INPUT (it does, and the metric scores
that 0.0) or FAILED (every model failed, score null; the job goes on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.text import blank, trimmed

KEY = ["sample_id", "model_id"]
TEXTS = ("response", "reference")
#: By metric: the columns it needs, what counts as lacking (empty, trimmed, blank, none), and the outcome.
POLICY: dict[str, tuple[tuple[str, ...], str, str]] = {
    **{m: (TEXTS, "empty", "SKIPPED") for m in ("bleu", "rouge", "chrf", "string_similarity")},
    "answer_accuracy": (("user_input", *TEXTS), "empty", "SKIPPED"),
    "context_relevance": (("user_input", "contexts"), "empty", "SKIPPED"),
    "groundedness": (("contexts",), "empty", "SKIPPED"),
    "agent_goal": (("messages",), "empty", "SKIPPED"),
    "tool_call_accuracy": (("reference_calls",), "empty", "SKIPPED"),
    "topic_adherence": (("messages", "topics"), "empty", "SKIPPED"),
    "semantic_similarity": (TEXTS, "blank", "ZERO_INPUT"),
    "factual_correctness": (TEXTS, "trimmed", "ZERO_INPUT"),
    "answer_correctness": (TEXTS, "trimmed", "ZERO_INPUT"),
    "context_precision": (("contexts",), "empty", "ZERO_INPUT"),
    "context_recall": (("reference", "contexts"), "trimmed", "ZERO_INPUT"),
    "context_entity_recall": (("reference", "contexts"), "trimmed", "ZERO_INPUT"),
    "noise_sensitivity": (("reference", "contexts"), "trimmed", "ZERO_INPUT"),
    "response_relevancy": (("user_input", "response"), "trimmed", "ZERO_INPUT"),
    "faithfulness": (("contexts",), "none", "FAILED"),
    "hallucination": (("contexts",), "none", "FAILED"),
}
LISTS = ("contexts", "messages", "topics", "reference_calls")


def policy(metric: str | tuple) -> tuple:
    """Needed columns, what counts as lacking, and the outcome, of a known metric or as the caller gives them."""
    return metric if isinstance(metric, tuple) else POLICY.get(metric, ((), "empty", "SKIPPED"))


def lacking(metric: str | tuple) -> Column:
    """Whether a sample lacks an input of the metric."""
    columns, rule, _ = policy(metric)
    out = F.lit(False)
    for c in columns:
        x = F.col(c)
        if rule == "none":
            bad = x.isNull()
        elif c in LISTS:
            bad = x.isNull() | (F.size(x) <= 0)
        elif rule == "blank":
            bad = blank(x)
        else:
            bad = x.isNull() | ({"empty": x, "trimmed": trimmed(x)}[rule] == "")
        out = out | bad
    return out


def complete(scores: DataFrame, calls: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """``scores`` by sample and model for every successful call (sample_id, model_id, ok): calls that list nothing score ``empty``."""
    good = calls.where("ok").select(*KEY).distinct()
    score = F.when(F.col("scored"), F.col("score")).otherwise(F.lit(empty))
    return good.join(scores.withColumn("scored", F.lit(True)), KEY, "left").select(*KEY, score.cast("double").alias("score"))


def with_outcome(samples: DataFrame, scores: DataFrame, metric: str | tuple) -> DataFrame:
    """sample_id, score, status for each row of ``samples``; ``scores`` has a row per sample that some model scored.

    A sample whose input is lacking gets the metric's outcome whatever ``scores`` say; one without a score, or
    with a null one, FAILED.
    """
    outcome = policy(metric)[2]
    status = F.when(F.col("lacks"), F.lit(outcome)).when(F.col("score").isNull(), F.lit("FAILED")).otherwise(F.lit("OK"))
    rows = samples.select("sample_id", lacking(metric).alias("lacks")).join(scores.select("sample_id", F.col("score").cast("double").alias("score")), "sample_id", "left")
    value = F.when(~F.col("lacks"), F.col("score"))
    if outcome == "ZERO_INPUT":
        value = F.when(F.col("lacks"), F.lit(0.0)).otherwise(F.col("score"))
    return rows.select("sample_id", value.alias("score"), status.alias("status"))
