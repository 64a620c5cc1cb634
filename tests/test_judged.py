"""Judge calls, outcomes, gates and reports: queries against their SQL, and small cases by hand or brute force."""

import glob
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeworks.functions.text import short_reason
from gradeworks.jobs import judged  # noqa: F401
from gradeworks.jobs.queries import QUERIES, SQL
from gradeworks.operators import embedding, judging, outcomes, reports, similarity, verdicts

SF = "/root/testdata/sf0.001"
OLDER = ["regression_gate", "format_conversation", "context_entity_recall", "token_limits"]
NAMES = [k for k, f in QUERIES.items() if k in SQL and f.__module__ == "gradeworks.jobs.judged"] + OLDER


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    norm = lambda r: [(x is None, round(float(x), 6) if isinstance(x, float) or x.__class__.__name__ == "Decimal" else x) for x in r]
    key = lambda r: [(x[0], str(x[1])) for x in r]
    assert sorted(map(norm, got.select(*names).collect()), key=key) == sorted(map(norm, want.fetchall()), key=key)


def calls(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, side string, call_idx long, name string, arguments map<string,string>")


def test_flexible_calls_by_hand(spark):
    a, r = "actual", "reference"
    data = [
        (1, a, 0, "f", {"x": "1", "y": "2"}), (1, r, 0, "f", {"x": "1", "y": "3"}), (1, r, 1, "f", {"x": "1", "y": "2"}),
        (2, a, 0, "f", {"x": "1"}), (2, r, 0, "f", {}), (3, a, 0, "f", None), (3, r, 0, "f", None),
        (4, r, 0, "g", {"x": "1"}), (5, a, 0, "g", {"x": "1"}), (6, a, 0, "g", {"x": None}), (6, r, 0, "g", {"x": None}),
        (7, a, 1, "f", {"x": "1", "y": "9"}), (7, a, 0, "f", {"x": "1", "y": "2"}), (7, r, 0, "f", {"x": "1", "y": "2"}),
    ]
    got = {x.sample_id: (x.tp, x.fp, x.fn, x.score) for x in verdicts.tool_calls_flexible(calls(spark, data)).collect()}
    assert got[1] == (1, 0, 1, pytest.approx(2 / 3)) and got[2] == (0, 1, 1, 0.0) and got[3] == (1, 0, 0, 1.0)
    assert got[4] == (0, 0, 1, 0.0) and got[5] == (0, 1, 0, None) and got[6] == (0, 1, 1, 0.0) and got[7] == (1, 1, 0, pytest.approx(2 / 3))
    half = {x.sample_id: x.tp for x in verdicts.tool_calls_flexible(calls(spark, data), 0.5).collect()}
    assert half[2] == 1 and half[7] == 1


def test_flexible_query_against_plain_matching(spark):
    got = {x.sample_id: (x.tp, x.fp, x.fn) for x in QUERIES["tool_calls_flexible"](spark, SF).collect()}
    e = judged._event_calls(spark, SF).withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).orderBy("event_id").collect()
    sides = {}
    for x in e:
        sides.setdefault(x.user_id * 1000 + x.day, ([], []))[x.event_id % 2].append((x.name, x.arguments or {}))
    for s, (actual, reference) in sides.items():
        free, tp = list(reference), 0
        for name, own in actual:
            score = [(-1.0 if n != name else (1.0 if not own else 0.5) if not w else sum(own.get(k) is not None and own.get(k) == v for k, v in w.items()) / len(w)) for n, w in free]
            if score and max(score) >= 0.6:
                free.pop(score.index(max(score)))
                tp += 1
        assert got[s] == (tp, len(actual) - tp, len(reference) - tp)
    assert len(got) == len(sides)


def test_chunks(spark):
    pack = embedding.pack_sentences
    assert pack("", 5, 3.0) == [""] and pack("short.", 5, 3.0) == ["short."]
    assert pack("One two. Three four! Five\nsix", 4, 3.0) == ["One two.", "Three four!", "Five six"]
    assert pack("A. " + "x" * 31 + " B. C.", 4, 3.0) == ["A.", "x" * 12, "x" * 12, "x" * 7 + " B.", "C."]
    assert pack("Hi! " + "y" * 25, 4, 3.0) == ["Hi!", "y" * 12, "y" * 12, "y"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a. b")], "i int, t string")
    assert [x.c for x in df.select(embedding.split_into_chunks(F.col("t"), 1).alias("c")).collect()] == [None, [""], ["a.", "b"]]
    got = {x.sample_id: x for x in QUERIES["text_chunks"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, open_ = [], None  # the same by a plain loop
        if d.text is not None and len(d.text) <= 300:
            want = [d.text]
        elif d.text is not None:
            for s in [x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", d.text) if x]:
                if len(s) > 300:
                    want += ([open_] if open_ else []) + [s[i : i + 300] for i in range(0, len(s), 300)]
                    open_ = None
                elif open_ and len(open_) + 1 + len(s) > 300:
                    want, open_ = want + [open_], s
                else:
                    open_ = f"{open_} {s}" if open_ else s
            want += [open_] if open_ else []
        assert got[d.doc_id].n_chunks == len(want) and got[d.doc_id].chunks_md5 == hashlib.md5("\x1e".join(want).encode()).hexdigest()


def test_longest_common_subsequence_and_jaro_winkler(spark):
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 25))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert similarity.lcs_length(a, b) == t[-1][-1]
    for a, b, want in (("frog", "fog", 0.925), ("fly", "ant", 0.0), ("hippo", "elephant", 0.441667), ("hippo", "zzzzzzzz", 0.0), ("hello", "hallo", 0.88)):
        assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)
    assert QUERIES["jaro_winkler"](spark, SF).count() > 100 and QUERIES["rouge_l"](spark, SF).count() > 100


def test_judge_hook_and_parsing(spark):
    def judge(prompts, models):
        if any("bad" in p for p in prompts):
            raise RuntimeError("HTTP 500")
        return ['{"score": 2, "reasoning": "r"}' if "good" in p else None if "none" in p else ValueError("") if "own" in p else "```json" for p in prompts]

    q = spark.createDataFrame([(i, "m0", p) for i, p in enumerate(["good", "bad", "none", "text", "good too", "own"])], "sample_id long, model_id string, prompt string").coalesce(1)
    got = {x.sample_id: x for x in judging.parse_responses(judging.run_judge(q, judge), "rating").collect()}
    assert [got[i].ok for i in range(6)] == [True, False, False, False, True, False] and got[0].parsed.score == 2
    assert "HTTP 500" in got[1].error and got[2].error is None and got[3].parsed is None and got[5].error == "ValueError"
    assert judging.run_judge(q.limit(0), judge).count() == 0
    texts = {
        "verdicts": '{"verdicts": [{"statement": "s", "reason": "r", "verdict": 1}]}', "noise": '{"verdicts": [{"statement": "s", "verdict": true, "reason": "r"}]}',
        "questions": '{"questions": [{"question": "q", "noncommittal": 0}]}', "topic_match": '{"classifications": [{"extractedTopic": "t", "onTopic": true, "matchedReferenceTopic": "", "reasoning": "r"}]}',
        "hallucination": '{"claims": [{"claim": "c", "status": "SUPPORTED", "reason": "r"}]}', "topics": '{"topics": ["a"]}', "entities": '{"entities": []}',
    }
    for kind in judging.SCHEMAS:
        df = spark.createDataFrame([(1, "m", True, texts.get(kind, "{}"), None), (2, "m", True, "{", None), (3, "m", True, None, None), (4, "m", False, None, "x")], "sample_id long, model_id string, ok boolean, response_json string, error string")
        assert [x.ok for x in judging.parse_responses(df, kind).orderBy("sample_id").collect()] == [True, False, False, False]


def test_conversation_with_tools_and_formats(spark):
    none = None
    data = [(1, 2, "assistant", "ok", [("f", {"b": "2", "a": "1"}), ("g", none)]), (1, 0, "user", "hi", none), (1, 1, "tool", none, none), (1, 3, "robot", "x", none), (2, 0, "user", "only", [("h", {})])]
    m = spark.createDataFrame(data, f"sample_id long, turn int, role string, content string, tool_calls array<{judging.CALL}>")
    got = dict(map(tuple, judging.format_conversation(m).collect()))
    assert got[1] == "[USER]: hi\n[TOOL]: \n[ASSISTANT]: ok\n  Tool calls:\n    - f(a=1, b=2)\n    - g()\n[UNKNOWN]: x" and got[2] == "[USER]: only"
    own = spark.createDataFrame([(2, 0, "k", "a=1")], "sample_id long, call_idx int, name string, args string")
    assert sorted(map(tuple, judging.actual_calls(own, m).collect())) == [(1, 0, "f", "a=1, b=2"), (1, 1, "g", ""), (2, 0, "k", "a=1")]
    one = spark.range(1).select(judging.format_rubrics(F.create_map(F.lit("score2_x"), F.lit("b"), F.lit("score1_x"), F.lit("a"))).alias("r"), judging.format_rubrics(F.create_map().cast("map<string,string>")).alias("e"), judging.format_statements(F.array(F.lit("p"), F.lit("q"))).alias("n"), judging.format_statements(F.array(F.lit("p"), F.lit("q")), False).alias("s")).first()
    assert tuple(one) == ("Score 1: a\nScore 2: b\n", None, "1. p\n2. q\n", "p\nq")


def test_gates_and_classes(spark):
    s = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.9), (2, "b", 0.5), (3, "a", None), (3, "b", 1.0), (4, "c", 1.0), (5, "a", 0.9), (5, "a", 0.1), (5, "b", 0.9)], "sample_id long, metric string, score double")
    got = {x.sample_id: (x.passed, x.n_failed) for x in verdicts.gate(s, {"a": 0.5, "b": 0.5}).collect()}
    assert got == {1: (False, 1), 2: (True, 0), 3: (False, 1), 4: (False, 2), 5: (False, 1)}
    c = lambda m, x: spark.range(1).select(verdicts.report_class(F.lit(m), F.lit(x).cast("double")).alias("c"), verdicts.format_score(F.lit(x).cast("double"), F.lit(m)).alias("t")).first()
    assert c("NoiseSensitivity", 0.2).c == "good" and c("RubricsScore", 3.0) == ("moderate", "3.0 / 5 → 50.00%") and c("Faithfulness", 0.6) == ("good", "60.00%") and c("x", None) == ("unknown", "N/A")
    reasons = spark.createDataFrame([(e,) for e in ("unexpected end-of-input", "No content to map", "Unexpected end", "500", None)], "e string")
    assert [x.r for x in reasons.select(short_reason(F.col("e")).alias("r")).collect()] == ["empty response", "empty response", "truncated JSON", "server error", "unknown error"]


def test_outcomes_and_empty_tables(spark):
    s = spark.createDataFrame([(1, "  ", "x"), (2, "a", "x"), (3, None, "x")], "sample_id long, response string, reference string")
    scores = spark.createDataFrame([(1, 0.5), (2, None)], "sample_id long, score double")
    got = {m: [(x.score, x.status) for x in outcomes.with_outcome(s, scores, m).orderBy("sample_id").collect()] for m in ("semantic_similarity", "bleu", "unknown")}
    assert got["semantic_similarity"] == [(0.0, "ZERO_INPUT"), (None, "FAILED"), (0.0, "ZERO_INPUT")]
    assert got["bleu"] == [(0.5, "OK"), (None, "FAILED"), (None, "SKIPPED")] and got["unknown"][2] == (None, "FAILED")
    v = spark.createDataFrame([], "sample_id long, model_id string, on_topic boolean, matched string")
    topics = spark.createDataFrame([(1, 2), (2, 0)], "sample_id long, n_topics int")
    assert [(x.sample_id, x.score) for x in verdicts.topic_adherence(v, topics).collect()] == [(1, 0.0)]
    empty = spark.createDataFrame([], "sample_id long, metric string, step_name string, step_index int, step_type string, model_id string, iteration int, ok boolean, duration_ms long")
    assert reports.timeline(empty).count() == 0 and reports.step_stats(empty).count() == 0 and reports.model_time_totals(empty).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, "m", "response", [1.0, 0.0]), (1, "m", "response", [0.0, 1.0]), (1, "m", "reference", [1.0, 1.0]), (1, "n", "response", [1.0]), (1, "n", "response", [1.0, 2.0]), (1, "n", "reference", [1.0]), (2, "m", "response", [1.0])], "sample_id long, model_id string, side string, embedding array<float>")
    assert [(x.sample_id, x.model_id, round(x.score, 9)) for x in embedding.semantic_similarity(v).collect()] == [(1, "m", 1.0)]
