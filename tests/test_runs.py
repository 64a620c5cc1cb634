"""Files in, calls that are made once, score tables out."""

import json
import math
import os
import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeworks.operators import calls, embedding, goals, judging, metrics, verdicts
from gradeworks.operators.calls import CallLog
from gradeworks.sources import tables

SF = "/root/testdata/sf0.001"


def counted(folder, reply):
    """A hook that notes each text it is asked in a file of its process."""

    def hook(texts, models):
        for t, m in zip(texts, models, strict=True):
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.write(json.dumps([m, t]) + "\n")
            yield reply(t)

    return hook


def asked(folder):
    return sorted(tuple(json.loads(x)) for p in pathlib.Path(folder).iterdir() for x in p.read_text().splitlines())


def requests(spark, texts):
    return spark.createDataFrame([(i, f"m{k}", t, "own") for i, t in enumerate(texts) for k in range(2)], "sample_id long, model_id string, prompt string, call string").drop("call")


def test_a_run_is_taken_up_again(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    texts = [f"prompt {i % 30}" for i in range(60)] + [None, "", "hot"] + ["hot"] * 400
    q, hook = requests(spark, texts), counted(tmp_path / "asked", lambda t: ValueError("no") if t == "prompt 7" else f"re {t}")
    log = CallLog(spark, str(tmp_path / "log"))
    log.ask(q.where("sample_id < 20"), hook)
    got = CallLog(spark, str(tmp_path / "log")).ask(q, hook, waves=3)
    for _ in range(2):
        rows = got.collect()
        assert len(rows) == 2 * len(texts)
        assert all(r.ok and r.response_json == f"re {r.prompt or ''}" for r in rows if r.prompt != "prompt 7")
        assert [r.error for r in rows if r.prompt == "prompt 7"] == ["no"] * 4
    want = sorted((m, t) for t in {*texts} - {None} for m in ("m0", "m1"))
    assert asked(tmp_path / "asked") == want and log.rows() == len(want)
    log.ask(q, hook, failed_again=True)
    assert len(asked(tmp_path / "asked")) == len(want) + 2


def test_replies_of_done_tasks_survive_a_job_that_breaks_off(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    q = requests(spark, [f"p{i}" for i in range(200)])

    def dying(texts, models):
        for t in texts:
            if t == "p150":
                raise SystemExit("worker lost")
            with open(f"{tmp_path}/asked/{os.getpid()}", "a") as f:
                f.write(json.dumps(["m", t]) + "\n")
            yield t

    log = CallLog(spark, str(tmp_path / "log"))
    with pytest.raises(Exception):  # noqa: B017
        log.ask(q, dying, tasks=32)
    kept = log.replies().count()
    rows = log.ask(q, counted(tmp_path / "asked", lambda t: t), tasks=32).collect()
    assert len(rows) == 400 and all(r.ok for r in rows)
    assert log.rows() == 400 and 0 < kept < 400


def test_nothing_is_asked_twice_by_a_hook_that_yields(spark):
    seen = []

    def hook(texts, models):
        for t in texts:
            seen.append(t)
            if t == "bad":
                raise RuntimeError("broken")
            yield t

    got = calls.answers(hook, pd.Series(["a", "bad", "b", "bad", "c"]), pd.Series(["m"] * 5))
    assert [str(r) for r, _ in got] == ["a", "broken", "b", "broken", "c"] and seen == ["a", "bad", "b", "bad", "c"]
    assert [str(r) for r, _ in calls.answers(lambda t, m: iter(["x"]), pd.Series(["a", "b"]), pd.Series(["m"] * 2))] == ["x", "no reply"]
    assert all("one reply" in str(r) for r, _ in calls.answers(lambda t, m: ["x"] * 3, pd.Series(["a", "b"]), pd.Series(["m"] * 2)))


def test_iterations_are_calls_of_their_own(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    q = judging.fan_out(spark.createDataFrame([(1, "p", 9)], "sample_id long, prompt string, iteration int"), ["m0"], 3)
    assert sorted(r.iteration for r in q.collect()) == [1, 2, 3]
    CallLog(spark, str(tmp_path / "log")).ask(q, counted(tmp_path / "asked", str))
    assert len(asked(tmp_path / "asked")) == 3


def test_fan_out_takes_any_columns(spark):
    s = spark.createDataFrame([(1, ["x", "y"], "a", "b", 1), (2, None, "a", "b", 2), (3, [], "a", "b", 3)], "sample_id long, contexts array<string>, m string, request string, model_pos int")
    each = judging.each_context(s)
    assert "contexts" not in each.columns and [(r.sample_id, r.ctx_idx, r.context) for r in each.orderBy("ctx_idx").collect()] == [(1, 0, "x"), (1, 1, "y")]
    out = judging.fan_out(each, ["p", "q"]).orderBy("ctx_idx", "model_pos").collect()
    assert [(r.ctx_idx, r.model_id, r.model_pos, r.m, r.request) for r in out] == [(0, "p", 0, "a", "b"), (0, "q", 1, "a", "b"), (1, "p", 0, "a", "b"), (1, "q", 1, "a", "b")]


def test_readers_keep_unreadable_rows(spark, tmp_path):
    lines = [
        '{"sample_id": 1, "user_input": "q", "tool_calls": [{"name": "f", "arguments": {"a": 5500, "b": "5500", "c": [1, {"d": null}], "e": null}}], "metadata": {"k": true}, "more": 1}',
        '{"sample_id": "one", "user_input": "q"}',
        '{"sample_id": 2, "user_input": ',
        '{"user_input": "no id"}',
        "",
        "[1, 2]",
        '{"sample_id": 3, "user_input_messages": [{"role": "user", "content": "ü"}]}',
    ]
    (tmp_path / "s.json").write_text("\n".join(lines))
    rows = tables.read_json(spark, str(tmp_path / "s.json"), "samples")
    good = {r.sample_id: r for r in tables.readable(rows).collect()}
    assert sorted(good) == [1, 3]
    assert good[1].tool_calls[0].arguments == {"a": "5500", "b": '"5500"', "c": '[1,{"d":null}]', "e": "null"} and good[1].metadata == {"k": "true"}
    assert good[3].user_input_messages[0].content == "ü" and good[3].tool_calls is None
    assert sorted(r.unreadable for r in rows.where("unreadable is not null").collect()) == sorted([lines[1], lines[2], lines[3], lines[5]])
    assert rows.where("user_input = 'no id'").count() == 1  # what can be read is there
    odd = spark.createDataFrame([("1", "0.5", [1.0], "m"), ("x", "0.5", None, "m"), ("3", "high", None, None), (None, "1", None, "m"), ("4", "1", None, "m")], "sample_id string, metric string, score array<double>, model_id string")
    odd.write.parquet(str(tmp_path / "p"))
    got = tables.read_parquet(spark, str(tmp_path / "p"), "scores_by_model")
    assert got.schema.fieldNames() == ["sample_id", "metric", "model_id", "score", "unreadable"] and dict(got.dtypes)["score"] == "double"
    assert sorted(str(r.unreadable) for r in got.collect()) == sorted(['{"score":[1.0]}', '{"sample_id":"x"}', "None", "{}", "None"])
    assert tables.readable(got).count() == 2
    part = tables.read_parquet(spark, str(tmp_path / "p"), "scores")
    assert part.schema.fieldNames() == ["sample_id", "metric", "score", "status", "unreadable"] and {r.status for r in part.collect()} == {None}
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert tables.read_json(spark, str(empty), "messages").count() == 0


def test_one_metric_is_replaced(spark, tmp_path):
    path = str(tmp_path / "scores")
    s = spark.createDataFrame([(i, m, i / 10, "OK", "x") for i in range(30) for m in ("a", "b", "c")] + [(1, None, None, None, "x")], "sample_id long, metric string, score double, status string, more string")
    tables.write_scores(s, path)
    files = lambda m: {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path, f"metric={m}").rglob("*.parquet")}
    before = {m: files(m) for m in "abc"}
    tables.write_scores(s.where("metric = 'b' and sample_id < 5").withColumn("score", F.lit(0.5)), path)
    assert files("a") == before["a"] and files("c") == before["c"] and files("b") != before["b"]
    got = tables.read_scores(spark, path)
    assert got.groupBy("metric").count().rdd.collectAsMap() == {"a": 30, "b": 5, "c": 30, None: 1}
    assert {r.score for r in tables.read_scores(spark, path, ["b"]).collect()} == {0.5}
    plan = tables.read_scores(spark, path, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan
    tables.write_scores(s.limit(0), path)
    assert got.count() == 66


def plain_mean(rows):
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    return {k: None if len({len(v) for v in vs}) > 1 or any(x is None for v in vs for x in v) else [sum(c) / len(vs) for c in zip(*vs, strict=True)] for k, vs in by.items()}


def test_means_of_whole_vectors(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", f"k{r.randrange(40)}", None]), [r.uniform(-1, 1) for _ in range(5)]) for _ in range(3000)]
    rows += [("k1", [1.0]), ("k2", [None] * 5), ("k3", None), ("only", None), ("odd", [1.0]), ("odd", [1.0, 2.0]), ("odd", [3.0])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "k string, embedding array<double>, one int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {x.k: x.embedding for x in embedding.average_embeddings(df.repartition(7), ["k", "one"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_mean(rows)
    assert got.keys() == want.keys() and "only" not in got
    assert all((got[k] is None and v is None) or np.allclose(got[k], v, atol=1e-12) for k, v in want.items())
    assert "Generate" not in embedding.average_embeddings(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert embedding.average_embeddings(df.limit(0), ["k"]).count() == 0


def test_similarity_from_texts(spark, tmp_path):
    (tmp_path / "asked").mkdir()

    def reply(t):
        if len(t) > 60:
            raise ValueError("too long")
        return [float(len(t)), float(t.count("e")), 1.0]

    long = "One sentence here. Another one follows! A third, is it? " * 3
    s = spark.createDataFrame([(1, "a text", "a text"), (2, long, "a text"), (3, " 　", "x"), (4, None, "x"), (5, "a text", "e")], "sample_id long, response string, reference string")
    log, hook = embedding.vector_log(spark, str(tmp_path / "log")), counted(tmp_path / "asked", reply)
    score = lambda how: {(r.sample_id, r.model_id): r.score for r in embedding.semantic_similarity_of_texts(s, log, hook, ["e0", "e1"], how, 20).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    chunks = embedding.pack_sentences(long, 20, 3.0)
    mean = [sum(c) / len(chunks) for c in zip(*map(reply, chunks), strict=True)]
    short = {1: 1.0, 5: cos(reply("a text"), reply("e"))}
    for how, two in (("CHUNK", cos(mean, reply("a text"))), ("TRUNCATE", cos(reply(long[:60]), reply("a text"))), ("FAIL_FAST", None)):
        got = score(how)
        want = {**short, **({2: two} if two is not None else {})}
        assert {k[0] for k in got} == set(want) and all(abs(got[k] - want[k[0]]) < 1e-9 for k in got) and len(got) == 2 * len(want)
    texts = {"a text", "e", long, long[:60], *chunks}
    assert asked(tmp_path / "asked") == sorted((m, t) for t in texts for m in ("e0", "e1"))


def test_goals_by_mode(spark, tmp_path):
    def judge(prompts, models):
        for p, m in zip(prompts, models, strict=True):
            if p.startswith("What did"):
                yield ValueError("HTTP 500") if "lost" in p or m == "m0" else json.dumps({"inferredGoal": f"goal of {m}"})
            else:
                yield json.dumps({"goalAchieved": "goal of m1" in p or m == "m2"})

    rows = [(1, "talk", "given"), (2, "talk", ""), (3, "talk", None), (4, "lost", None), (5, None, "given"), (6, "", "given")]
    s = spark.createDataFrame(rows, "sample_id long, conversation string, reference string")
    log = CallLog(spark, str(tmp_path / "log"))
    run = lambda mode: {r.sample_id: (r.goal, r.inferred, None if r.score is None else round(r.score, 3), r.status) for r in goals.goal_accuracy(s, log, judge, ["m0", "m1", "m2"], mode).collect()}
    inferred, none = ("goal of m1", True, 1.0, "OK"), (None, None, None, "SKIPPED")
    rest = {2: inferred, 3: inferred, 4: (None, None, None, "FAILED")}
    assert {k: v for k, v in run("WITH_REFERENCE").items() if k < 5} == {1: ("given", False, 0.333, "OK"), **rest}
    assert {k: v for k, v in run("WITHOUT_REFERENCE").items() if k < 5} == {1: inferred, **rest}
    assert run("WITHOUT_REFERENCE")[5] == none and run("WITH_REFERENCE")[6] == none
    with pytest.raises(ValueError):
        run("OTHER")


def test_long_conversations_in_chunks(spark):
    r = random.Random(3)
    rows = [(s, t, r.choice(["user", "assistant", None]), f"{s}-{t}" if r.random() < 0.9 else None) for s in range(3) for t in range(500 if s == 1 else 3)]
    rows.append((1, 7, "user", "a second turn of that number"))
    r.shuffle(rows)
    m = spark.createDataFrame([(*x, None) for x in rows], f"sample_id long, turn int, role string, content string, tool_calls array<{judging.CALL}>")
    whole = sorted(map(tuple, judging.format_conversation(m).collect()))
    assert whole == sorted(map(tuple, judging.format_conversation(m, 10).collect())) and whole[1][1].count("\n") == 500
    assert judging.format_conversation(m.limit(0), 10).count() == 0


def test_entities_as_rows(spark):
    rows = [("s", "m", "reference", x) for x in [" Paris", "paris ", "ROME", "", None, "Oslo"]] + [("s", "m", "context", x) for x in ["PARIS", "x"]] + [("t", "m", "context", "x"), ("u", "m", "reference", "a")]
    flags = verdicts.entity_flags(spark.createDataFrame(rows, "sample_id string, model_id string, side string, entity string"))
    assert {r.sample_id: (round(r.score, 6), r.n_missing) for r in verdicts.entity_recall_of_rows(flags).collect()} == {"s": (0.333333, 2), "t": (0.0, 0), "u": (0.0, 1)}
    assert sorted(r.entity for r in verdicts.missing_entity_rows(flags).where("sample_id = 's'").collect()) == ["oslo", "rome"]
    assert verdicts.entity_flags(flags.selectExpr("sample_id", "model_id", "'context' as side", "entity").limit(0)).count() == 0


def test_own_metrics_ask_only_where_input_is(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    s = spark.createDataFrame([(1, "a", "x"), (2, " ", "x"), (3, None, "x")], "sample_id long, response string, parsed string")
    m = metrics.Metric("own", "Rate {response} {parsed}", "score int", lambda p: p.select("sample_id", "model_id", F.col("parsed.score").cast("double").alias("score")), needs=("response",), lacking="trimmed", outcome="SKIPPED", over_models=lambda c: F.max(c))
    log, judge = CallLog(spark, str(tmp_path / "log")), counted(tmp_path / "asked", lambda t: '{"score": 4}')
    got = metrics.evaluate(s, [m, m], log, judge, ["m0", "m1"])
    assert sorted(map(tuple, got.distinct().collect()), key=str) == [(1, "own", 4.0, "OK"), (2, "own", None, "SKIPPED"), (3, "own", None, "SKIPPED")]
    assert asked(tmp_path / "asked") == [("m0", "Rate a x"), ("m1", "Rate a x")]
    tables.write_scores(got.distinct(), str(tmp_path / "scores"))
    assert tables.read_scores(spark, str(tmp_path / "scores"), ["own"]).count() == 3
