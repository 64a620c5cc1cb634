"""From samples to judge calls and back: prompts, fan-out, the judge hook, parsing, gating, exclusions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.text import short_reason
from gradeworks.operators.calls import run_hook

KEY = ["sample_id", "model_id"]
CALL = "struct<name:string,arguments:map<string,string>>"
ROLES = {"user": "USER", "assistant": "ASSISTANT", "tool": "TOOL"}

#: Prompts by metric; names in braces are columns, null ones are empty.
TEMPLATES = {
    "aspect": "Decide whether the answer meets the criterion.\nCriterion: {definition}\nQuestion: {user_input}\nAnswer: {response}\nReply in JSON with criteria, verdict (true or false) and reasoning.",
    "criteria": "Score the answer from {min} to {max}.\nCriterion: {definition}\nQuestion: {user_input}\nAnswer: {response}\nReference: {reference}\nReply in JSON with criteria, score and reasoning.",
    "rubrics": "Choose the level that describes the answer.\n{rubrics}Question: {user_input}\nAnswer: {response}\nReference: {reference}\nReply in JSON with score, rubric_level and reasoning.",
    "relevance": "Did this context help to reach the answer?\nQuestion: {user_input}\nAnswer: {answer}\nContext: {context}\nReply in JSON with relevant and reasoning.",
    "recall": "Which statements of the answer does the context support?\nQuestion: {user_input}\nContext: {context}\nAnswer: {reference}\nReply in JSON with classifications.",
    "entities": "List the named entities of this text.\n{text}\nReply in JSON with entities.",
    "statements": "Break the answer into statements.\nQuestion: {user_input}\nAnswer: {response}\nReply in JSON with statements.",
    "verdicts": "Which statements follow from the context?\nContext: {context}\nStatements:\n{statements}\nReply in JSON with verdicts.",
    "claims": "Break the text into claims.\n{text}\nReply in JSON with claims.",
    "nli": "Is each claim supported by the context?\nContext: {context}\nClaims:\n{statements}\nReply in JSON with verdicts.",
    "hallucination": "Which claims of the answer does the context not support?\nContext: {context}\nQuestion: {user_input}\nAnswer: {response}\nReply in JSON with claims.",
    "questions": "Write {n} questions that this answers, and whether it is noncommittal.\nQuestion: {user_input}\nAnswer: {response}\nReply in JSON with questions.",
    "rating": "Rate from 0 to 2.\nQuestion: {user_input}\nAnswer: {response}\nReference: {reference}\nContext: {context}\nReply in JSON with score and reasoning.",
    "inferred_goal": "What did the user want to reach?\n{conversation}\nReply in JSON with inferredGoal and reasoning.",
    "goal": "Was the goal reached?\nGoal: {goal}\n{conversation}\nReply in JSON with goalAchieved and reasoning.",
    "topics": "List the topics of the conversation.\n{conversation}\nReply in JSON with topics.",
    "topic_match": "Which topics belong to the reference topics?\nTopics:\n{statements}\nReference topics:\n{reference_topics}\nReply in JSON with classifications.",
}

# The fields of the judges' replies, by kind of call.
SCHEMAS = {
    "aspect": "criteria string, verdict boolean, reasoning string",
    "criteria": "criteria string, score double, reasoning string",
    "rubrics": "score int, rubric_level string, reasoning string",
    "statements": "statements array<string>",
    "verdicts": "verdicts array<struct<statement:string,reason:string,verdict:int>>",
    "noise": "verdicts array<struct<statement:string,verdict:boolean,reason:string>>",
    "recall": "classifications array<struct<statement:string,reason:string,attributed:int>>",
    "relevance": "relevant boolean, reasoning string",
    "entities": "entities array<string>",
    "questions": "questions array<struct<question:string,noncommittal:int>>",
    "claims": "claims array<string>",
    "nli": "verdicts array<struct<claim:string,verdict:string,reason:string>>",
    "hallucination": "claims array<struct<claim:string,status:string,reason:string>>",
    "rating": "score int, reasoning string",
    "goal": "goalAchieved boolean, reasoning string",
    "inferred_goal": "inferredGoal string, reasoning string",
    "topics": "topics array<string>",
    "topic_match": "classifications array<struct<extractedTopic:string,onTopic:boolean,matchedReferenceTopic:string,reasoning:string>>",
}


def _line() -> Column:
    role = F.lit("UNKNOWN")
    for r, name in ROLES.items():
        role = F.when(F.col("role") == r, F.lit(name)).otherwise(role)
    text = F.concat(F.lit("["), role, F.lit("]: "), F.coalesce("content", F.lit("")))
    call = lambda c: F.concat(F.lit("\n    - "), c["name"], F.lit("("), _entries(c["arguments"]), F.lit(")"))
    calls = F.coalesce("tool_calls", F.array().cast(f"array<{CALL}>"))
    tools = F.concat(F.lit("\n  Tool calls:"), F.array_join(F.transform(calls, call), ""))
    return F.concat(text, F.when((F.col("role") == "assistant") & (F.size(calls) > 0), tools).otherwise(F.lit("")))


def _entries(arguments: Column) -> Column:
    """Arguments as text, by name."""
    entries = F.array_sort(F.map_entries(F.coalesce(arguments, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")


def format_conversation(messages: DataFrame, chunk: int | None = None) -> DataFrame:
    """sample_id, conversation: the turns of ``messages`` (sample_id, turn, role, content, tool_calls) in order, one a line.

    With ``chunk``, turns are first put together within ranges of so many turn numbers, then the ranges, so a
    conversation of very many turns is sorted by many tasks. Equal turns are ordered by their lines.
    """

    def joined(rows: DataFrame, by: list[str], at: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(at, "line")))
        return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("line"))

    rows = messages.select("sample_id", "turn", _line().alias("line"))
    if chunk:
        rows = joined(rows.withColumn("turns", F.floor(F.col("turn") / chunk)), ["sample_id", "turns"], "turn").withColumnRenamed("turns", "turn")
    return joined(rows, ["sample_id"], "turn").withColumnRenamed("line", "conversation")


def last_message(role: str) -> Column:
    """Aggregate: the last content of a role by turn, else an empty text."""
    own = F.col("role") == role
    return F.coalesce(F.max_by(F.when(own, F.col("content")), F.when(own, F.col("turn"))), F.lit(""))


def extract_tool_calls(messages: DataFrame) -> DataFrame:
    """sample_id, call_idx, name, args: the calls of assistant turns, numbered in order through a sample. args is text, by argument name."""
    calls = F.when(F.col("role") == "assistant", F.col("tool_calls"))
    each = messages.groupBy("sample_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(calls, F.array().cast(f"array<{CALL}>")).alias("calls")).alias("t")), lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)), lambda t: t["calls"])).alias("calls"))
    return each.select("sample_id", F.posexplode("calls").alias("call_idx", "c")).select("sample_id", "call_idx", "c.name", _entries(F.col("c.arguments")).alias("args"))


def actual_calls(own: DataFrame, messages: DataFrame) -> DataFrame:
    """A sample's own calls (sample_id, call_idx, name, args), or those of its messages if it has none."""
    return own.unionByName(extract_tool_calls(messages).join(own.select("sample_id").distinct(), "sample_id", "left_anti"))


def format_statements(items: Column, numbered: bool = True) -> Column:
    """Items as lines: ``1. text`` each with a line feed, or plain ones joined by line feeds."""
    if not numbered:
        return F.array_join(items, "\n")
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")


def format_rubrics(rubric: Column) -> Column:
    """Levels by key, ``Score <digits>: description`` a line; null for an empty rubric."""
    line = lambda e: F.concat(F.lit("Score "), F.regexp_replace(e["key"], "[^0-9]", ""), F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\n"))
    return F.when(F.size(rubric) > 0, F.array_join(F.transform(F.array_sort(F.map_entries(rubric)), line), ""))


def render_prompts(df: DataFrame, metric: str, **values: str | int) -> DataFrame:
    """``df`` with ``prompt``: the metric's template, its names filled from ``values`` or else from columns."""
    return render(df, TEMPLATES[metric], **values)


def render(df: DataFrame, template: str, **values: str | int) -> DataFrame:
    """``render_prompts`` for a template of the caller's own."""
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        known = F.lit(str(values[part])) if i % 2 and part in values else None
        parts.append(F.lit(part) if i % 2 == 0 else known if known is not None else F.coalesce(F.col(part).cast("string"), F.lit("")))
    return df.withColumn("prompt", F.concat(*parts))


def fan_out(requests: DataFrame, models: list[str], iterations: int = 1) -> DataFrame:
    """A row per request, model (model_id, model_pos) and iteration (from 1). Columns of these names are replaced, all others stay."""
    own = ("model_id", "model_pos", "iteration")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("model_id"), F.lit(i).alias("model_pos"), F.lit(t).alias("iteration")) for i, x in enumerate(models) for t in range(1, iterations + 1)]))
    out = requests.drop(*own).select(F.struct("*").alias("request"), each.alias("to"))
    return out.select("request.*", *[f"to.{c}" for c in own])


def each_context(samples: DataFrame, contexts: str = "contexts") -> DataFrame:
    """A row per element of the array ``contexts``, which gives way to ctx_idx and context; samples whose array is null or empty have none.

    Render prompts before models are attached (``fan_out``), so each is made once and no row carries the array.
    """
    rest = [c for c in samples.columns if c not in (contexts, "ctx_idx", "context")]
    return samples.select(*rest, F.posexplode(contexts).alias("ctx_idx", "context"))


def run_judge(requests: DataFrame, judge: Callable[[pd.Series, pd.Series], Iterable]) -> DataFrame:
    """``requests`` (prompt, model_id and other columns) with ok, response_json, error and duration_ms; a bad call is a failed row, never a failed job.

    ``judge`` takes a batch's prompts and models and yields a reply or an exception for each (``calls.answers``). The
    result is lazy: every use of it asks the judge. ``calls.CallLog`` keeps replies.
    """
    return run_hook(requests, judge, "prompt", "response_json", "string")


def parse_responses(results: DataFrame, kind: str) -> DataFrame:
    """``results`` with ``parsed`` (struct of the kind's schema); replies that are no such JSON turn into failures."""
    return parse(results, SCHEMAS[kind])


def parse(results: DataFrame, fields: str) -> DataFrame:
    """``parse_responses`` for fields of the caller's own. A column ``parsed`` of the caller's is replaced."""
    schema = f"{fields}, broken string"
    p = results.withColumn("parsed", F.from_json("response_json", schema, {"columnNameOfCorruptRecord": "broken"}))
    bad = F.col("ok") & (F.col("parsed").isNull() | F.col("parsed.broken").isNotNull())
    error = F.when(bad, F.concat(F.lit("JSON parse error: "), F.coalesce("response_json", F.lit("")))).otherwise(F.col("error"))
    return p.withColumn("error", error).withColumn("ok", F.coalesce("ok", F.lit(False)) & ~bad).withColumn("parsed", F.when(F.col("ok"), F.col("parsed").dropFields("broken")))


def gate_models(*steps: DataFrame) -> DataFrame:
    """(sample_id, model_id) of the models that succeeded at every step (tables with ok; any failed call of a step ends a model)."""
    out = None
    for step in steps:
        good = step.groupBy(*KEY).agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select(*KEY)
        out = good if out is None else out.join(good, KEY, "left_semi")
    return out


def exclusions(results: DataFrame) -> DataFrame:
    """A row per failed call: sample_id, model_id, step_name, step_index, reason (short)."""
    return results.where(~F.coalesce("ok", F.lit(False))).select(*KEY, "step_name", "step_index", short_reason(F.col("error")).alias("reason"))


def excluded_models(results: DataFrame) -> DataFrame:
    """sample_id, excluded: the distinct models with a failed call, by name."""
    return exclusions(results).groupBy("sample_id").agg(F.array_sort(F.collect_set("model_id")).alias("excluded"))


def first_success(results: DataFrame, value: Column) -> DataFrame:
    """sample_id, value: that of the successful call whose model comes first (model_pos) and whose value isn't null."""
    return results.where(F.col("ok")).select("sample_id", "model_pos", value.alias("value")).where("value is not null").groupBy("sample_id").agg(F.min_by("value", "model_pos").alias("value"))
