"""Metrics of a caller's own: a prompt, the fields of a reply and a score, evaluated like the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.operators import judging, outcomes, verdicts
from gradeworks.operators.calls import CallLog


@dataclass(frozen=True)
class Metric:
    """A metric that asks a judge.

    ``prompt`` names columns of samples in braces, ``reply`` the fields of the JSON that comes back, and ``score`` turns
    successful replies (sample_id, model_id, iteration, parsed) into sample_id, model_id, score. A sample that lacks
    one of ``needs`` (by the rule ``lacking``: empty, trimmed, blank or none) isn't asked about and gets ``outcome``.
    """

    name: str
    prompt: str
    reply: str
    score: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    lacking: str = "empty"
    outcome: str = "SKIPPED"
    iterations: int = 1
    over_models: str | Callable[[Column], Column] = "average"


def evaluate(samples: DataFrame, metrics: list[Metric], log: CallLog, judge: Callable, models: list[str]) -> DataFrame:
    """sample_id, metric, score, status of each sample and metric, as ``tables.write_scores`` takes them.

    Every metric's calls go through ``log``: those that it has are not made again, whatever metric asked before.
    """
    out = None
    for m in metrics:
        rule = (m.needs, m.lacking, m.outcome)
        prompts = judging.render(samples.where(~outcomes.lacking(rule)), m.prompt).select("sample_id", "prompt")
        replies = judging.parse(log.ask(prompts, judge, models=models, iterations=m.iterations), m.reply).where("ok")
        scores = verdicts.over_models(m.score(replies), m.over_models)
        one = outcomes.with_outcome(samples, scores, rule).select("sample_id", F.lit(m.name).alias("metric"), "score", "status")
        out = one if out is None else out.unionByName(one)
    return out
