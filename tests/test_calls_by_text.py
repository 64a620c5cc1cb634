"""Calls for several models: a text is shuffled once, requests get the replies that a fan-out before the call gets, also frequent ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.operators import judging
from gradeworks.operators.calls import CallLog


def hook(texts, models):
    for t, m in zip(texts, models, strict=True):
        yield ValueError("no") if (t, m) == ("t3", "b") else f"{m}:{t}"


def test_models_given_to_the_log_are_those_of_a_fan_out(spark, tmp_path):
    q = spark.range(3000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).when(F.col("id") % 2 == 0, F.lit("often")).alias("prompt"))
    before = CallLog(spark, str(tmp_path / "a"))
    want = before.ask(judging.fan_out(q, ["a", "b", "a"], 2), hook)
    log = CallLog(spark, str(tmp_path / "b"))
    log.ask(q.where("sample_id < 50"), hook, models=["b"])
    known = log.rows()
    got = log.ask(q, hook, models=["a", "b", "a"], iterations=2)
    columns = ["sample_id", "prompt", "model_id", "model_pos", "iteration", "ok", "response_json", "error"]
    assert set(got.columns) == set(want.columns)
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert key(got) == key(want) and got.count() == 3000 * 6
    assert known > 0 and log.rows() == before.rows() == 602 * 4


def test_a_text_is_shuffled_once_whatever_number_of_models_it_goes_to(spark, tmp_path, monkeypatch):
    from gradeworks.operators import calls

    plans, run = [], calls.run_hook
    monkeypatch.setattr(calls, "run_hook", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), run(df, *a))[1])
    q = spark.range(10).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("prompt"))
    CallLog(spark, str(tmp_path / "c")).ask(q, hook, models=["a", "b"], iterations=3)
    assert len(plans) == 1 and "Generate" not in plans[0]
