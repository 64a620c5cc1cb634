"""Whether agents reached the users' goals: given ones, or goals that a judge infers first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.operators import judging, outcomes, verdicts
from gradeworks.operators.calls import CallLog

MODES = ("WITH_REFERENCE", "WITHOUT_REFERENCE")


def goals(samples: DataFrame, log: CallLog, judge: Callable, models: list[str], mode: str = "WITH_REFERENCE") -> DataFrame:
    """sample_id, conversation, goal, inferred for each of ``samples`` (sample_id, conversation, reference) that has a goal.

    With references, a sample's own goal is its reference; one whose reference is null or empty is treated as without.
    Without, all models are asked for the goal and that of the first one in the list that names any goes to
    every model; a sample for which none does has no goal.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    talks = samples.where(F.length("conversation") > 0)
    given = F.coalesce(F.length("reference") > 0, F.lit(False)) if mode == MODES[0] else F.lit(False)
    named = talks.where(given).select("sample_id", "conversation", F.col("reference").alias("goal"), F.lit(False).alias("inferred"))
    rest = talks.where(~given).select("sample_id", "conversation")
    prompts = judging.render_prompts(rest, "inferred_goal").select("sample_id", "prompt")
    replies = judging.parse_responses(log.ask(prompts, judge, models=models), "inferred_goal")
    first = judging.first_success(replies, F.col("parsed.inferredGoal"))
    return named.unionByName(rest.join(first, "sample_id").select("sample_id", "conversation", F.col("value").alias("goal"), F.lit(True).alias("inferred")))


def goal_accuracy(samples: DataFrame, log: CallLog, judge: Callable, models: list[str], mode: str = "WITH_REFERENCE") -> DataFrame:
    """sample_id, goal, inferred, score, status for each of ``samples``: the share of models that see the goal reached.

    All models judge, those too that named no goal. SKIPPED without a conversation, FAILED without a goal or if every
    model failed.
    """
    found = goals(samples, log, judge, models, mode)
    prompts = judging.render_prompts(found, "goal").select("sample_id", "prompt")
    replies = judging.parse_responses(log.ask(prompts, judge, models=models), "goal").where("ok")
    score = verdicts.over_models(verdicts.agent_goal(replies.select("sample_id", "model_id", F.col("parsed.goalAchieved").alias("goal_achieved"))))
    talks = samples.select("sample_id", F.when(F.length("conversation") > 0, F.array("conversation")).alias("messages"))
    out = outcomes.with_outcome(talks, score, "agent_goal")
    return out.join(found.select("sample_id", "goal", "inferred"), "sample_id", "left").select("sample_id", "goal", "inferred", "score", "status")
