"""Registered queries on judge calls, outcomes, reports, gates and streams, most with the same result in SQL."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from gradeworks.jobs.queries import PAIRS, QUERIES, _grams, _rounded, query
from gradeworks.operators import embedding, judging, outcomes, reports, similarity, verdicts
from gradeworks.operators.calls import CallLog
from gradeworks.sources import derived
from gradeworks.sources.shared import new_folder
from gradeworks.streaming import monitor

MODELS = list(derived.MODELS)


def plain(f):
    """Register a query that SQL can't express; tests hold it against a brute-force version."""
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return derived.table(spark, d, "documents").withColumnRenamed("doc_id", "sample_id")


# Calls of three models for each document, of which some fail and some reply with broken JSON.
CALLS = """c AS (SELECT doc_id AS sample_id, 'm' || pos AS model_id, pos, it, (doc_id * 31 + pos * 13 + it * 5) % 20 AS h, (doc_id * 7 + pos * 3 + it) % 6 AS x, (doc_id + pos + it) % 9 = 0 AS nul
    FROM documents, (SELECT unnest(range(3)) AS pos), (SELECT unnest(range({0})) AS it))"""


def _calls(spark, d, iterations=1):
    c = judging.fan_out(_docs(spark, d).select("sample_id"), MODELS, iterations).withColumnRenamed("model_pos", "pos").withColumn("it", F.col("iteration") - 1)
    i, p, t = F.col("sample_id"), F.col("pos"), F.col("it")
    return c.withColumn("h", (i * 31 + p * 13 + t * 5) % 20).withColumn("x", (i * 7 + p * 3 + t) % 6).withColumn("nul", (i + p + t) % 9 == 0)


def _replied(calls, reply):
    error = F.when(F.col("x") % 3 == 0, "HTTP 429 Too Many Requests").when(F.col("x") % 3 == 1, "Read Timeout after 30s")
    text = F.when(F.col("h") == 1, F.lit('{"score": ')).otherwise(reply)
    cols = {"ok": F.col("h") != 0, "response_json": F.when(F.col("h") != 0, text), "error": F.when(F.col("h") == 0, error), "duration_ms": F.when(F.col("h") != 5, 100 + (F.col("sample_id") * 13 + F.col("pos") * 71 + F.col("it") * 37) % 900), "step_name": F.lit("verdict"), "step_index": F.lit(0), "model_pos": F.col("pos")}
    return calls.withColumns(cols)


def _aspects(spark, d):
    verdict = F.when(F.col("nul"), "null").otherwise((F.col("x") % 2 == 0).cast("string"))
    return judging.parse_responses(_replied(_calls(spark, d, 3), F.concat(F.lit('{"criteria": "c", "verdict": '), verdict, F.lit(', "reasoning": "r"}'))), "aspect")


@query(f"""WITH {CALLS.format(3)}, s AS (SELECT sample_id, model_id, CASE WHEN avg(CASE WHEN x % 2 = 0 AND NOT nul THEN 1 ELSE 0 END) > 0.5 THEN 1.0 ELSE 0.0 END AS s FROM c WHERE h > 1 GROUP BY ALL)
    SELECT doc_id AS sample_id, round(avg(s), 9) AS score, CASE WHEN count(s) = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM documents LEFT JOIN s ON sample_id = doc_id GROUP BY doc_id""")
def aspect_critic_calls(spark, d):
    v = _aspects(spark, d).where("ok").select("sample_id", "model_id", F.col("parsed.verdict").alias("verdict"))
    return _rounded(outcomes.with_outcome(_docs(spark, d), verdicts.over_models(verdicts.aspect_critic(v)), "aspect"))


@query(f"""WITH {CALLS.format(3)} SELECT sample_id, model_id, it, CASE WHEN h = 1 THEN 'parse error' WHEN x % 3 = 0 THEN 'rate limited' WHEN x % 3 = 1 THEN 'timeout' ELSE 'unknown error' END AS reason FROM c WHERE h <= 1""")
def judge_exclusions(spark, d):
    r = _aspects(spark, d).withColumn("step_index", F.col("it"))
    return judging.exclusions(r).select("sample_id", "model_id", F.col("step_index").cast("long").alias("it"), "reason")


@query(f"""WITH {CALLS.format(3)}, k AS (SELECT sample_id, model_id, min(h) > 1 AS ok FROM c GROUP BY ALL)
    SELECT sample_id, coalesce(string_agg(model_id, ',' ORDER BY model_id) FILTER (ok), '') AS gated, coalesce(string_agg(model_id, ',' ORDER BY model_id) FILTER (NOT ok), '') AS excluded FROM k GROUP BY sample_id""")
def gated_models(spark, d):
    r = _aspects(spark, d)
    good = judging.gate_models(*[r.where(F.col("it") == i) for i in range(3)]).groupBy("sample_id").agg(F.array_sort(F.collect_list("model_id")).alias("gated"))
    both = _docs(spark, d).select("sample_id").join(good, "sample_id", "left").join(judging.excluded_models(r), "sample_id", "left")
    return both.select("sample_id", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("gated", "excluded")])


_ERRORS = [
    ("The model gave an empty text", "empty response"), ("unexpected end-of-input", "empty response"), ("No content to map due to x", "empty response"),
    ("Unexpected character (code 96)", "markdown in response"), ("starts with ```json", "markdown in response"), ("Unrecognized token Sure", "text before JSON"),
    ("was expecting closing quote", "truncated JSON"), ("Unexpected end of input", "truncated JSON"), ("No fallback setter/field defined", "duplicate JSON key"),
    ("Duplicate duplicate key", "duplicate JSON key"), ("Duplicate key", "Duplicate key"), ("cannot Parse this", "parse error"), ("bad JSON", "parse error"), ("Read Timeout", "timeout"),
    ("it timed out", "it timed out"), ("HTTP 429", "rate limited"), ("Unauthorized", "auth error"), ("403 Forbidden", "403 Forbidden"), ("Internal Server Error", "server error"),
    ("502 Bad Gateway", "502 Bad Gateway"), ("one\ntwo", "one two"), ("z" * 51, "z" * 47 + "..."), ("z" * 50, "z" * 50), (" ", "unknown error"), (None, "unknown error"),
]


def _case(k: int) -> str:
    return "CASE " + " ".join(f"WHEN doc_id % {len(_ERRORS)} = {i} THEN '{e[k]}'" for i, e in enumerate(_ERRORS) if e[k] is not None) + " END"


@query(f"SELECT doc_id AS sample_id, {_case(1)} AS reason FROM documents")
def failure_reasons(spark, d):
    error = F.lit(None).cast("string")
    for i, (e, _) in enumerate(_ERRORS):
        if e is not None:
            error = F.when(F.col("sample_id") % len(_ERRORS) == i, e).otherwise(error)
    return _docs(spark, d).select("sample_id", judging.short_reason(error).alias("reason"))


# A judge whose reply follows from the prompt alone: some calls fail, some replies are no JSON.
def _reply(make):
    def judge(prompts: pd.Series, models: pd.Series) -> list:
        for p, m in zip(prompts, models, strict=True):
            n = int(hashlib.md5(f"{m}|{p}".encode()).hexdigest()[:6], 16)
            yield ValueError("HTTP 429") if n % 13 == 0 else "sorry" if n % 17 == 0 else json.dumps(make(n))

    return judge


def _log(spark):
    return CallLog(spark, new_folder(spark, "calls"))


def _n(prompt: str) -> str:
    return f"CAST('0x' || substr(md5(model_id || '|' || {prompt}), 1, 6) AS BIGINT)"


def _sql_prompt(metric: str, **values: str) -> str:
    out = "'" + judging.TEMPLATES[metric].replace("'", "''") + "'"
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


_HALVES = "list_value(substr(text, 1, CAST(length(text) // 2 AS BIGINT)), substr(text, CAST(length(text) // 2 AS BIGINT) + 1))"
_CTX = f"""q AS (SELECT *, {_sql_prompt('relevance', user_input='lang', answer="coalesce(source, '')", context='context')} AS prompt
    FROM (SELECT doc_id AS sample_id, lang, source, unnest({_HALVES}) AS context, unnest(range(2)) AS ctx_idx FROM documents WHERE text IS NOT NULL), (SELECT 'm' || unnest(range(3)) AS model_id))"""


def _context_prompts(spark, d, iterations=1):
    h = F.floor(F.length("text") / 2).cast("int")
    s = _docs(spark, d).where("text is not null").select("sample_id", F.col("lang").alias("user_input"), F.col("source").alias("answer"), F.array(F.substring(F.col("text"), F.lit(1), h), F.substring(F.col("text"), h + 1, F.length("text"))).alias("contexts"))
    return judging.fan_out(judging.render_prompts(judging.each_context(s), "relevance").select("sample_id", "ctx_idx", "prompt"), MODELS, iterations)


@query(f"WITH {_CTX} SELECT sample_id, model_id, ctx_idx, it AS iteration, md5(prompt) AS prompt_md5 FROM q, (SELECT unnest(range(1, 3)) AS it)")
def context_prompts(spark, d):
    p = _context_prompts(spark, d, 2)
    return p.select("sample_id", "model_id", F.col("ctx_idx").cast("long").alias("ctx_idx"), F.col("iteration").cast("long").alias("iteration"), F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {_CTX}, n AS (SELECT *, {_n('prompt')} AS n FROM q), v AS (SELECT sample_id, model_id, ctx_idx, n % 13 <> 0 AND n % 17 <> 0 AS ok, CASE WHEN n % 13 <> 0 AND n % 17 <> 0 AND n % 5 > 0 AND n % 5 < 3 THEN 1 ELSE 0 END AS r FROM n),
    k AS (SELECT *, sum(r) OVER (PARTITION BY sample_id, model_id ORDER BY ctx_idx) / (ctx_idx + 1) AS p FROM v)
    SELECT sample_id, model_id, round(CASE WHEN sum(r) = 0 THEN 0 ELSE sum(p * r) / sum(r) END, 9) AS score, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS n_failed FROM k GROUP BY ALL""")
def context_precision_run(spark, d):
    """Prompts for each context and model, the judge, its replies parsed; a failed call counts as not relevant."""
    make = _reply(lambda n: {"relevant": None if n % 5 == 0 else n % 5 < 3, "reasoning": "r"})
    r = judging.parse_responses(_log(spark).ask(_context_prompts(spark, d), make), "relevance").select("sample_id", "model_id", "ctx_idx", "ok", F.col("parsed.relevant").alias("relevant"))
    score = _rounded(verdicts.context_precision(r))
    return score.join(r.groupBy("sample_id", "model_id").agg(F.sum((~F.col("ok")).cast("long")).alias("n_failed")), ["sample_id", "model_id"])


_CONV = """v AS (SELECT conv_id AS sample_id, string_agg('[' || CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' WHEN 'tool' THEN 'TOOL' ELSE 'UNKNOWN' END || ']: ' || coalesce(text, ''), chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id)"""


def _messages(spark, d):
    c = derived.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("sample_id"), "turn", "role", F.col("text").alias("content"), F.lit(None).cast(f"array<{judging.CALL}>").alias("tool_calls"))


def _run_sql(metric: str, name: str, value: str, **values: str) -> str:
    return f"{name} AS (SELECT sample_id, avg({value}) AS score FROM (SELECT *, {_n('p')} AS n FROM (SELECT sample_id, 'm' || pos AS model_id, {_sql_prompt(metric, **values)} AS p FROM v, (SELECT unnest(range(3)) AS pos))) WHERE n % 13 <> 0 AND n % 17 <> 0 GROUP BY sample_id)"


@query(f"""WITH {_CONV}, {_run_sql('goal', 'g', 'CASE WHEN n % 4 > 0 THEN 1.0 ELSE 0.0 END', goal="'goal ' || sample_id", conversation='conversation')},
    {_run_sql('aspect', 's', 'CASE WHEN n % 7 > 0 THEN 1.0 ELSE 0.0 END', definition="'harmless'", user_input='conversation', response="''")},
    {_run_sql('rubrics', 'r', '1 + n % 5', rubrics="'Score 1: bad' || chr(10) || 'Score 5: good' || chr(10)", user_input='conversation', response="''", reference="''")}
    SELECT v.sample_id, round(g.score, 9) AS agent_goal, round(s.score, 9) AS safety, round(r.score, 9) AS completeness,
        coalesce(g.score >= 1, false) AND coalesce(s.score >= 1, false) AND coalesce(r.score >= 0.6, false) AS passed
    FROM v LEFT JOIN g ON g.sample_id = v.sample_id LEFT JOIN s ON s.sample_id = v.sample_id LEFT JOIN r ON r.sample_id = v.sample_id""")
def regression_run(spark, d):
    """A run over conversations from messages to the gate: three metrics of the judge's, mean over models, thresholds."""
    c = judging.format_conversation(_messages(spark, d)).withColumn("goal", F.concat(F.lit("goal "), F.col("sample_id").cast("string")))
    c = c.withColumn("user_input", F.col("conversation")).withColumn("rubrics", judging.format_rubrics(F.create_map(F.lit("score5_description"), F.lit("good"), F.lit("score1_description"), F.lit("bad"))))
    runs = {
        "agent_goal": ("goal", {}, lambda n: {"goalAchieved": n % 4 > 0, "reasoning": "r"}, lambda p: verdicts.agent_goal(p.select("sample_id", "model_id", F.col("parsed.goalAchieved").alias("goal_achieved")))),
        "safety": ("aspect", {"definition": "harmless", "response": ""}, lambda n: {"criteria": "c", "verdict": n % 7 > 0, "reasoning": "r"}, lambda p: verdicts.aspect_critic(p.select("sample_id", "model_id", F.col("parsed.verdict").alias("verdict")))),
        "completeness": ("rubrics", {"response": "", "reference": ""}, lambda n: {"score": 1 + n % 5, "rubric_level": "l", "reasoning": "r"}, lambda p: verdicts.rubrics_score(p.select("sample_id", "model_id", F.col("parsed.score").alias("score")))),
    }
    scores, log = None, _log(spark)
    for name, (metric, values, make, score) in runs.items():
        prompts = judging.fan_out(judging.render_prompts(c, metric, **values).select("sample_id", "prompt"), MODELS)
        parsed = judging.parse_responses(log.ask(prompts, _reply(make)), metric).where("ok")
        one = verdicts.over_models(score(parsed)).select("sample_id", F.lit(name).alias("metric"), F.col("score").cast("double").alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    every = c.select("sample_id", F.explode(F.array(*[F.lit(m) for m in runs])).alias("metric")).join(scores, ["sample_id", "metric"], "left")
    limits = {m: verdicts.REGRESSION[m] for m in runs}
    wide = every.groupBy("sample_id").agg(*[F.round(F.max(F.when(F.col("metric") == m, F.col("score"))), 9).alias(m) for m in runs])
    return wide.join(verdicts.gate(every, limits).drop("n_failed"), "sample_id")


@query("""WITH s AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN substr(text, 1, CAST(length(text) // 2 AS BIGINT)) WHEN 1 THEN '  ' || lower(text) || chr(10) WHEN 2 THEN '' ELSE 'never said ' || doc_id END AS response FROM documents WHERE doc_id % 5 <> 4 AND text IS NOT NULL),
    j AS (SELECT doc_id, avg(((doc_id * 7 + pos * 3) % 6) / 4.0) AS score FROM (SELECT doc_id, unnest(range(3)) AS pos FROM documents) WHERE (doc_id * 31 + pos * 13) % 20 > 1 AND (doc_id * 7 + pos * 3) % 6 < 3 GROUP BY doc_id)
    SELECT d.doc_id AS sample_id, round(CASE WHEN s.response = '' THEN 0.0 WHEN contains(lower(s.text), lower(regexp_replace(s.response, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))) OR lower(s.text) = lower(regexp_replace(s.response, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) THEN 1.0 WHEN s.doc_id IS NOT NULL THEN j.score END, 9) AS score,
        CASE WHEN s.doc_id IS NULL THEN 'SKIPPED' WHEN s.response = '' OR contains(lower(s.text), lower(regexp_replace(s.response, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))) OR j.score IS NOT NULL THEN 'OK' ELSE 'FAILED' END AS status
    FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id""")
def groundedness(spark, d):
    i = F.col("sample_id")
    own = F.when(i % 5 == 0, F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))).when(i % 5 == 1, F.concat(F.lit("  "), F.lower("text"), F.lit("\n"))).when(i % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("never said "), i.cast("string")))
    s = _docs(spark, d).select("sample_id", own.alias("response"), F.when((i % 5 != 4) & F.col("text").isNotNull(), F.array("text")).alias("contexts"))
    ratings = _calls(spark, d).where("h > 1 and x < 3").select("sample_id", (F.col("x") / 2).alias("score"))
    return _rounded(outcomes.with_outcome(s, verdicts.response_groundedness(s, ratings), "groundedness"))


@query(f"""WITH {CALLS.format(1)}, g AS (SELECT sample_id, arg_min('goal ' || x, pos) AS goal FROM c WHERE h > 1 AND NOT nul GROUP BY sample_id),
    s AS (SELECT sample_id, avg(CASE WHEN (sample_id + pos + length(goal)) % 3 > 0 AND h <> 7 THEN 1.0 ELSE 0.0 END) AS score FROM c JOIN g USING (sample_id) WHERE h <> 2 GROUP BY sample_id)
    SELECT doc_id AS sample_id, goal, round(score, 9) AS score, CASE WHEN score IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM documents LEFT JOIN g ON g.sample_id = doc_id LEFT JOIN s ON s.sample_id = doc_id""")
def agent_goal(spark, d):
    """The first model's goal goes to all models; one that fails to name a goal still judges it."""
    goal = F.when(F.col("nul"), "null").otherwise(F.concat(F.lit('"goal '), F.col("x").cast("string"), F.lit('"')))
    named = judging.parse_responses(_replied(_calls(spark, d), F.concat(F.lit('{"inferredGoal": '), goal, F.lit(', "reasoning": "r"}'))), "inferred_goal")
    first = judging.first_success(named, F.col("parsed.inferredGoal")).withColumnRenamed("value", "goal")
    judged = _calls(spark, d).join(first, "sample_id").where("h <> 2")
    v = judged.select("sample_id", "model_id", F.when(F.col("h") != 7, (F.col("sample_id") + F.col("pos") + F.length("goal")) % 3 > 0).alias("goal_achieved"))
    s = outcomes.with_outcome(_docs(spark, d), verdicts.over_models(verdicts.agent_goal(v)), "goal")
    return _rounded(s).join(first, "sample_id", "left")


def _event_calls(spark, d):
    e = derived.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    args = F.map_from_entries(F.filter(F.array(F.struct(F.lit("k").alias("key"), (k % 3).cast("string").alias("value")), F.struct(F.lit("v").alias("key"), F.when(k % 7 > 0, (F.floor("value") % 2).cast("string")).alias("value")), F.struct(F.lit("w").alias("key"), (k % 2).cast("string").alias("value"))), lambda x: (x["key"] != "w") | (k % 5 > 0)))
    return e.select("user_id", "event_id", "ts", F.col("event_type").alias("name"), F.when(k % 11 > 0, args).alias("arguments"))


@plain
def tool_calls_flexible(spark, d):
    e = _event_calls(spark, d)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    calls = e.select((F.col("user_id") * 1000 + day).alias("sample_id"), F.when(F.col("event_id") % 2 == 0, "actual").otherwise("reference").alias("side"), F.col("event_id").alias("call_idx"), "name", "arguments")
    return _rounded(verdicts.tool_calls_flexible(calls, 0.6))


@query("""SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS call_idx, event_type AS name, 'k=' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS args FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 1""")
def extract_tool_calls(spark, d):
    e = derived.table(spark, d, "events")
    k = (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")
    call = F.array(F.struct(F.col("event_type").alias("name"), F.create_map(F.lit("k"), k).alias("arguments")))
    m = e.select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("content"), F.when(F.col("event_id") % 4 != 1, call).alias("tool_calls"))
    return judging.extract_tool_calls(m).withColumn("call_idx", F.col("call_idx").cast("long"))


@query(f"""WITH {CALLS.format(4)}, g AS (SELECT sample_id, model_id, avg(CASE WHEN x % 2 = 0 AND NOT nul THEN 1.0 ELSE 0.0 END) AS p, count(DISTINCT CASE WHEN x % 2 = 0 AND NOT nul AND x > 0 THEN x END) AS m FROM c WHERE h > 3 AND sample_id % 6 > 0 GROUP BY ALL),
    k AS (SELECT DISTINCT sample_id, model_id FROM c WHERE it = 0 AND h > 1 AND sample_id % 10 > 0),
    s AS (SELECT doc_id AS sample_id, doc_id % 4 AS n, k.model_id, coalesce(p, 0) AS p, coalesce(m, 0) / (doc_id % 4) AS r FROM documents LEFT JOIN k ON k.sample_id = doc_id LEFT JOIN g ON g.sample_id = doc_id AND g.model_id = k.model_id WHERE doc_id % 4 > 0)
    SELECT doc_id AS sample_id, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS score, CASE WHEN doc_id % 4 = 0 THEN 'SKIPPED' ELSE 'OK' END AS status FROM documents LEFT JOIN s ON s.sample_id = doc_id GROUP BY doc_id""")
def topic_adherence(spark, d):
    c = _calls(spark, d, 4)
    on = F.when(~F.col("nul"), F.col("x") % 2 == 0)
    t = c.where("h > 3 and sample_id % 6 > 0").select("sample_id", "model_id", on.alias("on_topic"), F.when(F.col("x") > 0, F.col("x").cast("string")).otherwise("").alias("matched"))
    calls = c.where("it = 0 and sample_id % 10 > 0").select("sample_id", "model_id", (F.col("h") > 1).alias("ok"))
    n = F.col("sample_id") % 4
    samples = _docs(spark, d).select("sample_id", n.alias("n_topics"), F.array(F.lit("m")).alias("messages"), F.slice(F.array(*[F.lit(str(i)) for i in range(4)]), F.lit(1), n.cast("int")).alias("topics"))
    return _rounded(outcomes.with_outcome(samples, verdicts.over_models(verdicts.topic_adherence(t, samples.select("sample_id", "n_topics"), calls=calls)), "topic_adherence"))


_ROUNDS = f"""{CALLS.format(2)}, r AS (SELECT sample_id, pos, it + 1 AS round, CASE WHEN NOT nul THEN x % 3 END AS score, 'why ' || x AS reasoning FROM c WHERE h > 3 AND (it = 0 OR sample_id % 3 = 0))"""


def _rounds(spark, d):
    c = _calls(spark, d, 2).where("h > 3 and (it = 0 or sample_id % 3 = 0)")
    return c.select("sample_id", F.col("pos").alias("model_pos"), F.col("iteration").alias("round"), F.when(~F.col("nul"), F.col("x") % 3).alias("score"), F.concat(F.lit("why "), F.col("x").cast("string")).alias("reasoning"))


@query(f"WITH {_ROUNDS}, s AS (SELECT sample_id, coalesce(avg(score / 2.0) FILTER (round = 2), avg(score / 2.0) FILTER (round = 1)) AS s FROM r GROUP BY sample_id) SELECT doc_id AS sample_id, round(s, 9) AS score, CASE WHEN s IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM documents LEFT JOIN s ON sample_id = doc_id")
def answer_accuracy(spark, d):
    s = _docs(spark, d).select("sample_id", *[F.lit("x").alias(c) for c in ("user_input", "response", "reference")])
    return _rounded(outcomes.with_outcome(s, verdicts.answer_accuracy(_rounds(spark, d)), "answer_accuracy"))


@query(f"WITH {_ROUNDS} SELECT sample_id, CAST(floor(avg(score / 2.0) * 2 + 0.5) AS INTEGER) AS rating, arg_min(reasoning, pos) AS reasoning FROM r WHERE round = 1 AND score IS NOT NULL GROUP BY sample_id")
def dual_judge_seed(spark, d):
    return verdicts.dual_judge_seed(_rounds(spark, d))


@query(f"""WITH {CALLS.format(1)}, s AS (SELECT sample_id, avg(CASE WHEN nul THEN 0 ELSE 1 + x % 5 END) AS level, 2 + sample_id % 8 AS high FROM c WHERE h > 1 GROUP BY sample_id), p AS (SELECT *, (level - 1) / (high - 1) AS place FROM s)
    SELECT sample_id, round(level, 9) AS level, round(place, 9) AS normalized, CASE WHEN place <= 0.33 THEN 'poor' WHEN place <= 0.66 THEN 'moderate' ELSE 'good' END AS class, printf('%.1f / %d → %.2f%%', level, high, place * 100) AS text FROM p""")
def rubric_levels(spark, d):
    reply = F.concat(F.lit('{"score": '), F.when(F.col("nul"), "null").otherwise((1 + F.col("x") % 5).cast("string")), F.lit(', "rubric_level": "l", "reasoning": "r"}'))
    p = judging.parse_responses(_replied(_calls(spark, d), reply), "rubrics").where("ok").select("sample_id", "model_id", F.col("parsed.score").alias("score"))
    s = verdicts.over_models(verdicts.rubrics_score(p))
    keys = F.transform(F.sequence(F.lit(1), (2 + F.col("sample_id") % 8).cast("int")), lambda i: F.concat(F.lit("score"), i.cast("string"), F.lit("_description")))
    rubric = F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit("text")))
    s = s.withColumn("rubric", rubric)
    r = verdicts.rubric_range(F.col("rubric"))
    name = F.lit("RubricsScore")
    return s.select("sample_id", F.round("score", 9).alias("level"), F.round(verdicts.normalize_rubric(F.col("score"), F.col("rubric")), 9).alias("normalized"), verdicts.report_class(name, F.col("score"), r["low"], r["high"]).alias("class"), verdicts.format_score(F.col("score"), name, r["low"], r["high"]).alias("text"))


_LEVEL = "CASE WHEN s IS NULL THEN 'unknown' WHEN s {0} THEN 'excellent' WHEN s {1} THEN 'good' WHEN s {2} THEN 'moderate' ELSE 'poor' END"


@query(f"""WITH t AS (SELECT doc_id AS sample_id, m AS metric, CASE WHEN (doc_id + length(m)) % 12 > 0 THEN (doc_id * 13 + length(m)) % 21 / 20 END AS s FROM documents, (SELECT unnest(['NoiseSensitivity', 'Faithfulness', 'Hallucination']) AS m))
    SELECT sample_id, metric, {_LEVEL.format('>= 0.9', '>= 0.7', '>= 0.5')} AS level, {_LEVEL.format('<= 0.1', '<= 0.3', '<= 0.5')} AS inverted, coalesce(s <= 0.2, false) AS good,
        CASE WHEN metric = 'NoiseSensitivity' THEN {_LEVEL.format('<= 0.1', '<= 0.3', '<= 0.5')} ELSE {_LEVEL.format('>= 0.8', '>= 0.6', '>= 0.4')} END AS class, CASE WHEN s IS NULL THEN 'N/A' ELSE printf('%.2f%%', s * 100) END AS text FROM t""")
def report_rows(spark, d):
    m = F.col("metric")
    t = _docs(spark, d).select("sample_id", F.explode(F.array(*[F.lit(x) for x in ("NoiseSensitivity", "Faithfulness", "Hallucination")])).alias("metric"))
    t = t.withColumn("s", F.when((F.col("sample_id") + F.length(m)) % 12 > 0, (F.col("sample_id") * 13 + F.length(m)) % 21 / 20))
    s = F.col("s")
    return t.select("sample_id", "metric", verdicts.score_level(s).alias("level"), verdicts.score_level_inverted(s).alias("inverted"), verdicts.is_good(s).alias("good"), verdicts.report_class(m, s).alias("class"), verdicts.format_score(s, m).alias("text"))


@query("""SELECT doc_id AS sample_id, round(coalesce(CASE WHEN doc_id % 5 > 0 AND doc_id % 11 > 0 THEN doc_id % 7 / 6 END, 0) * 0.75 + coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 / 8 END, 0) * 0.25, 9) AS score FROM documents WHERE doc_id % 5 > 0 OR doc_id % 4 > 0""")
def answer_correctness(spark, d):
    i = F.col("sample_id")
    a = _docs(spark, d).where("sample_id % 5 > 0").select("sample_id", F.when(i % 11 > 0, i % 7 / 6).alias("score"))
    b = _docs(spark, d).where("sample_id % 4 > 0").select("sample_id", (i % 9 / 8).alias("score"))
    return _rounded(verdicts.answer_correctness(a, b))


_V = "((sample_id * 31 + {1} * 7 + pos * 13 + {0}) % 5 < 3)"


@query(f"""WITH a AS (SELECT doc_id AS sample_id, 'm' || pos AS model_id, pos, s FROM documents, (SELECT unnest(range(3)) AS pos), (SELECT unnest(range(4)) AS s) WHERE doc_id % 13 > 0),
    g AS (SELECT sample_id, pos, x, bool_or({_V.format(1, '(x * 4 + s)')}) AS good FROM a, (SELECT unnest(range(3)) AS x) WHERE (sample_id + x) % 7 > 0 GROUP BY ALL),
    w AS (SELECT a.sample_id, a.model_id, a.pos, a.s, CASE WHEN (a.sample_id + a.s) % 6 > 0 THEN NOT {_V.format(0, 's')} ELSE true END AS wrong FROM a),
    b AS (SELECT a.sample_id, a.model_id, a.s, bool_or({_V.format(3, '(x * 4 + s)')} AND coalesce(good, false)) AS by_good, bool_or({_V.format(3, '(x * 4 + s)')} AND NOT coalesce(good, false)) AS by_bad
        FROM a CROSS JOIN (SELECT unnest(range(3)) AS x) LEFT JOIN g USING (sample_id, pos, x) GROUP BY ALL)
    SELECT w.sample_id, w.model_id, round(avg(CASE WHEN wrong AND by_bad AND NOT by_good THEN 1.0 ELSE 0.0 END), 9) AS score FROM w JOIN b ON b.sample_id = w.sample_id AND b.model_id = w.model_id AND b.s = w.s GROUP BY ALL""")
def noise_irrelevant(spark, d):
    """With contexts whose calls failed and verdicts that are null."""
    a = judging.fan_out(_docs(spark, d).where("sample_id % 13 > 0").select("sample_id"), MODELS).withColumn("stmt_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v = lambda shift, idx: (F.col("sample_id") * 31 + idx * 7 + F.col("model_pos") * 13 + shift) % 5 < 3
    answer = a.select("sample_id", "model_id", "stmt_idx", F.when((F.col("sample_id") + F.col("stmt_idx")) % 6 > 0, v(0, F.col("stmt_idx"))).alias("verdict"))
    c = a.withColumn("ctx_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = F.col("ctx_idx") * 4 + F.col("stmt_idx")
    ref = c.where((F.col("sample_id") + F.col("ctx_idx")) % 7 > 0).withColumn("verdict", v(1, at))
    return _rounded(verdicts.noise_sensitivity(answer, ref, c.withColumn("verdict", v(3, at)), relevant=False))


_SPACE = "regexp_replace({0}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_SAMPLE = """s AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN ' ' || chr(10) WHEN doc_id % 7 > 2 THEN text END AS response, CASE WHEN doc_id % 5 > 0 THEN text END AS reference, doc_id % 3 AS n FROM documents)"""
_RULES = {
    "bleu": ("coalesce(response, '') = '' OR coalesce(reference, '') = ''", "SKIPPED"),
    "semantic_similarity": (f"coalesce({_SPACE.format('response')}, '') = '' OR coalesce({_SPACE.format('reference')}, '') = ''", "ZERO_INPUT"),
    "context_recall": (f"coalesce({_SPACE.format('reference')}, '') = '' OR n < 2", "ZERO_INPUT"),
    "faithfulness": ("n = 0", "FAILED"),
    "groundedness": ("n < 2", "SKIPPED"),
}
_SCORE = "CASE WHEN (sample_id * 3 + length('{0}')) % 8 > 0 THEN (sample_id + length('{0}')) % 11 / 10 END"


@query(f"WITH {_SAMPLE} " + " UNION ALL ".join(f"SELECT sample_id, '{m}' AS metric, round(CASE WHEN {r} THEN {'0.0' if o == 'ZERO_INPUT' else 'NULL'} ELSE {_SCORE.format(m)} END, 9) AS score, CASE WHEN {r} THEN '{o}' WHEN {_SCORE.format(m)} IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM s" for m, (r, o) in _RULES.items()))
def input_outcomes(spark, d):
    """What metrics make of samples with null, empty and blank inputs, and of samples that every model failed."""
    i, text = F.col("sample_id"), F.col("text")
    contexts = F.when(i % 3 == 1, F.array().cast("array<string>")).when(i % 3 == 2, F.array(text))
    s = _docs(spark, d).select("sample_id", F.when(i % 7 == 0, "").when(i % 7 == 1, " \n").when(i % 7 > 2, text).alias("response"), F.when(i % 5 > 0, text).alias("reference"), contexts.alias("contexts"))
    out = None
    for m in _RULES:
        scores = s.select("sample_id", F.when((i * 3 + len(m)) % 8 > 0, (i + len(m)) % 11 / 10).alias("score"))
        one = _rounded(outcomes.with_outcome(s, scores, m)).select("sample_id", F.lit(m).alias("metric"), "score", "status")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CALLS.format(2)}, s AS (SELECT sample_id, model_id, avg(CASE WHEN x < 3 THEN 1.0 ELSE 0.0 END) AS s FROM c WHERE h > 1 AND sample_id % 5 > 0 GROUP BY ALL),
    k AS (SELECT DISTINCT sample_id, model_id FROM c WHERE it = 0 AND h <> 3) SELECT k.sample_id, k.model_id, round(coalesce(s, 0), 9) AS score FROM k LEFT JOIN s ON s.sample_id = k.sample_id AND s.model_id = k.model_id""")
def faithfulness_calls(spark, d):
    """Calls that listed no statement score 0, models whose call failed have no row."""
    c = _calls(spark, d, 2)
    v = c.where("h > 1 and sample_id % 5 > 0").select("sample_id", "model_id", (F.col("x") < 3).cast("int").alias("flag"))
    return _rounded(outcomes.complete(verdicts.faithfulness(v), c.where("it = 0").withColumn("ok", F.col("h") != 3)))


@query(f"WITH {CALLS.format(4)}, m AS (SELECT sample_id, model_id, sum(CASE WHEN x % 2 = 0 AND NOT nul THEN 1 ELSE 0 END) AS p, count(*) AS n FROM c WHERE h > 3 GROUP BY ALL) SELECT sample_id, round(avg(greatest(p, n - p) / n * 100), 6) AS percent, bool_or(p > 0 AND p < n) AS disagree FROM m GROUP BY sample_id")
def iteration_agreement(spark, d):
    v = _calls(spark, d, 4).where("h > 3").select("sample_id", "model_id", F.when(~F.col("nul"), F.col("x") % 2 == 0).alias("verdict"))
    return verdicts.iteration_agreement(v).withColumn("percent", F.round("percent", 6))


@query(f"WITH {CALLS.format(1)} SELECT sample_id, CASE WHEN max(x) - min(x) <= 3 THEN round(avg(x / 10), 9) END AS score, CASE WHEN max(x) - min(x) <= 3 THEN 'OK' ELSE 'FAILED' END AS status, CASE WHEN max(x) - min(x) > 3 THEN printf('range %.4f exceeds tolerance %.4f', (max(x) - min(x)) / 10, 0.3) END AS error FROM c GROUP BY sample_id")
def consensus(spark, d):
    return _rounded(verdicts.consensus(_calls(spark, d).select("sample_id", "model_id", (F.col("x") / 10).alias("score")), 0.3))


@query(f"WITH {CALLS.format(1)} SELECT sample_id, round(exp(avg(ln(x + 1))) - 1, 9) AS score FROM c GROUP BY sample_id")
def own_aggregator(spark, d):
    """An aggregator of the user's: a geometric mean."""
    return _rounded(verdicts.over_models(_calls(spark, d).select("sample_id", F.col("x").alias("score")), lambda s: F.exp(F.avg(F.log(s + 1))) - 1))


@query("SELECT doc_id AS sample_id, CASE WHEN doc_id % 4 < 2 THEN 'RESPONSE' ELSE 'REFERENCE' END AS strategy, 'RESPONSE' AS asked FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '[\\x00-\\x20]+', '', 'g') <> ''")
def precision_strategies(spark, d):
    i = F.col("sample_id")
    t = _docs(spark, d).where(F.regexp_replace("text", r"[\x00-\x20]+", "") != "")
    r = F.when(i % 4 == 1, "\t ").when(i % 4 > 1, F.col("text"))
    return t.select("sample_id", verdicts.precision_strategy(r, "REFERENCE").alias("strategy"), verdicts.precision_strategy(r, "RESPONSE").alias("asked"))


@query("""SELECT doc_id AS sample_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS missing FROM (SELECT doc_id,
    list_distinct(list_filter(list_transform(list_slice(w, 1, len(w) - len(w) // 2), lambda x: lower(regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))), lambda x: x <> '')) AS a,
    list_distinct(list_filter(list_transform(list_slice(w, len(w) // 2 + 1, len(w)), lambda x: lower(regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))), lambda x: x <> '')) AS b
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL))""")
def missing_entities(spark, d):
    from gradeworks.functions.text import normalized_entities

    w = F.split("text", " ")
    h = F.floor(F.size(w) / 2).cast("int")
    e = _docs(spark, d).where("text is not null").select("sample_id", F.lit("m0").alias("model_id"), normalized_entities(F.slice(w, 1, F.size(w) - h)).alias("reference"), normalized_entities(F.slice(w, h + 1, F.size(w))).alias("context"))
    return verdicts.missing_entities(e).select("sample_id", F.array_join("missing", " ").alias("missing"))


@query("""WITH f AS (SELECT vec_id // 8 AS sample_id, 'm' || (vec_id // 8) % 3 AS model_id, vec_id % 8 < 3 + vec_id // 8 % 2 AS r, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    m AS (SELECT sample_id, model_id, r, list(x ORDER BY i) AS v FROM (SELECT sample_id, model_id, r, i, avg(x) AS x FROM f GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT a.sample_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.r AND NOT b.r)
    SELECT sample_id, round(s, 6) AS score, CAST(s >= 0.1 AS DOUBLE) AS above FROM s""")
def chunked_similarity(spark, d):
    """Mean chunk vectors of both sides, their cosine, and that against a threshold, mean over models."""
    e = derived.table(spark, d, "embeddings")
    s = F.floor(F.col("vec_id") / 8).cast("long")
    v = e.select(s.alias("sample_id"), F.concat(F.lit("m"), (s % 3).cast("string")).alias("model_id"), F.when(F.col("vec_id") % 8 < 3 + s % 2, "response").otherwise("reference").alias("side"), "embedding")
    score, above = (verdicts.over_models(embedding.semantic_similarity(v, t)) for t in (None, 0.1))
    return score.withColumn("score", F.round("score", 6)).join(above.withColumnRenamed("score", "above"), "sample_id")


@query("""WITH e AS (SELECT vec_id // 8 AS sample_id, vec_id % 8 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT sample_id, v FROM e WHERE i = 0),
    q AS (SELECT sample_id, 'm' || (i - 1) // 3 AS model_id, i, (sample_id * 3 + i) % 4 = 0 OR (sample_id + (i - 1) // 3) % 6 = 0 AS no, (sample_id + i) % 5 = 0 AS blank, v FROM e WHERE i BETWEEN 1 AND 6 AND (sample_id + (i - 1) // 3) % 9 > 0)
    SELECT sample_id, model_id, round(CASE WHEN bool_and(no) THEN 0.0 ELSE avg(list_dot_product(q.v, u.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(u.v, u.v)))) FILTER (NOT blank) END, 6) AS score FROM q JOIN u USING (sample_id) GROUP BY ALL""")
def response_relevancy(spark, d):
    e = derived.table(spark, d, "embeddings")
    s, i = F.floor(F.col("vec_id") / 8).cast("long"), F.col("vec_id") % 8
    e = e.select(s.alias("sample_id"), i.alias("i"), "embedding").where("i between 0 and 6").withColumn("m", F.floor((F.col("i") - 1) / 3).cast("int"))
    q = e.where("i > 0 and (sample_id + m) % 9 > 0").select("sample_id", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_id"), F.col("i").alias("q_idx"), F.when((F.col("sample_id") + F.col("i")) % 5 == 0, " ").otherwise("why?").alias("question"), ((F.col("sample_id") * 3 + F.col("i")) % 4 == 0).cast("int").alias("a"), ((F.col("sample_id") + F.col("m")) % 6 == 0).cast("int").alias("b")).withColumn("noncommittal", F.greatest("a", "b"))
    v = e.select("sample_id", F.explode(F.array(F.struct(F.lit("e1").alias("embedding_model"), F.lit(1).alias("embedding_pos")), F.struct(F.lit("e0").alias("embedding_model"), F.lit(0).alias("embedding_pos")))).alias("k"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_id"), F.when(F.col("i") == 0, -1).otherwise(F.col("i")).alias("q_idx"), F.col("embedding"))
    v = v.select("sample_id", "k.*", "model_id", "q_idx", F.when((F.col("k.embedding_pos") == 0) | (F.col("q_idx") != -1), F.col("embedding")).alias("embedding"))
    return embedding.response_relevancy(q, v).withColumn("score", F.round("score", 6))


STEPS = """r AS (SELECT doc_id AS sample_id, 'goal' AS metric, st AS step_index, 's' || st AS step_name, CASE WHEN st = 2 THEN 'EMBEDDING' ELSE 'LLM' END AS step_type, 'm' || pos AS model_id, it, (doc_id * 31 + pos * 13 + it * 5 + st) % 20 > 1 AS ok,
    CASE WHEN (doc_id + st + pos) % 10 > 0 THEN 100 + (doc_id * 13 + pos * 71 + it * 37 + st * 11) % 900 END AS ms FROM documents, (SELECT unnest(range(3)) AS pos), (SELECT unnest(range(2)) AS it), (SELECT unnest(range(3)) AS st) WHERE it = 0 OR st = 1)"""


def _steps(spark, d):
    c = judging.fan_out(_docs(spark, d).select("sample_id"), MODELS, 2).withColumn("step_index", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("iteration = 1 or step_index = 1")
    i, p, t, s = F.col("sample_id"), F.col("model_pos"), F.col("iteration") - 1, F.col("step_index")
    return c.select("sample_id", F.lit("goal").alias("metric"), s.cast("long").alias("step_index"), F.concat(F.lit("s"), s.cast("string")).alias("step_name"), F.when(s == 2, "EMBEDDING").otherwise("LLM").alias("step_type"), "model_id", "model_pos", "iteration", ((i * 31 + p * 13 + t * 5 + s) % 20 > 1).alias("ok"), F.when((i + s + p) % 10 > 0, 100 + (i * 13 + p * 71 + t * 37 + s * 11) % 900).alias("duration_ms"))


@query(f"WITH {STEPS} SELECT sample_id, metric, step_index, step_name, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, round(avg(CAST(ok AS INTEGER)), 9) AS success_rate, coalesce(max(ms), 0) AS duration_ms FROM r GROUP BY ALL")
def step_stats(spark, d):
    return reports.step_stats(_steps(spark, d)).withColumn("success_rate", F.round("success_rate", 9))


@query(f"WITH {STEPS}, m AS (SELECT sample_id, metric, model_id, CAST(sum(ms) FILTER (step_type = 'LLM') AS BIGINT) AS l, max(ms) FILTER (step_type = 'EMBEDDING') AS e FROM r GROUP BY ALL) SELECT sample_id, metric, coalesce(max(l), 0) AS llm_ms, coalesce(max(e), 0) AS embedding_ms FROM m GROUP BY ALL")
def model_time_totals(spark, d):
    return reports.model_time_totals(_steps(spark, d))


@query(f"""WITH {STEPS}, s AS (SELECT sample_id, step_index, coalesce(max(ms), 0) AS d FROM r GROUP BY ALL), o AS (SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY sample_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM s)
    SELECT sample_id, metric, step_index, step_name, CASE WHEN step_index = 1 THEN model_id || ' (iter ' || it + 1 || ')' ELSE model_id END AS label, ok, start_ms, start_ms + coalesce(ms, 0) AS end_ms FROM r JOIN o USING (sample_id, step_index)""")
def timeline(spark, d):
    return reports.timeline(_steps(spark, d))


_MODEL_SCORES = f"{STEPS}, x AS (SELECT sample_id, metric, model_id FROM r GROUP BY ALL HAVING NOT bool_and(ok)), s AS (SELECT sample_id, metric, model_id, (sample_id * 7 + CAST(substr(model_id, 2) AS BIGINT)) % 11 / 10 AS score FROM r GROUP BY ALL HAVING bool_and(ok))"


def _model_scores(spark, d):
    r = _steps(spark, d)
    gone = r.where("not ok").select("sample_id", "metric", "model_id").distinct()
    kept = r.select("sample_id", "metric", "model_id", "model_pos").distinct().join(gone, ["sample_id", "metric", "model_id"], "left_anti")
    return r, gone, kept.withColumn("score", (F.col("sample_id") * 7 + F.col("model_pos")) % 11 / 10)


@query(f"WITH {_MODEL_SCORES} SELECT sample_id, metric, model_id, score, false AS excluded FROM s UNION ALL SELECT sample_id, metric, model_id, 0.0, true FROM x")
def score_entries(spark, d):
    _, gone, scores = _model_scores(spark, d)
    return reports.score_entries(scores, gone)


@query(f"""WITH {_MODEL_SCORES}, t AS (SELECT sample_id, metric, CAST(sum(d) AS BIGINT) AS duration_ms FROM (SELECT sample_id, metric, step_index, coalesce(max(ms), 0) AS d FROM r GROUP BY ALL) GROUP BY ALL)
    SELECT sample_id, metric, (SELECT round(avg(score), 9) FROM s WHERE s.sample_id = t.sample_id) AS score, coalesce((SELECT string_agg(model_id || '=' || printf('%.1f', score), ',' ORDER BY model_id) FROM s WHERE s.sample_id = t.sample_id), '') AS model_scores,
        coalesce((SELECT string_agg(model_id, ',' ORDER BY model_id) FROM x WHERE x.sample_id = t.sample_id), '') AS excluded, duration_ms FROM t""")
def evaluation_result(spark, d):
    r, _, scores = _model_scores(spark, d)
    e = reports.evaluation_result(scores, r)
    entry = lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.1f", x["value"]))
    own = F.coalesce(F.array_join(F.transform(F.map_entries("model_scores"), entry), ","), F.lit(""))
    return e.select("sample_id", "metric", F.round("score", 9).alias("score"), own.alias("model_scores"), F.array_join("excluded", ",").alias("excluded"), "duration_ms")


@query(f"WITH {CALLS.format(5)} SELECT sample_id, model_id, it + 1 AS item, CASE WHEN nul THEN false ELSE x >= 3 END AS passed FROM c WHERE h > 1")
def verdict_items(spark, d):
    v = _calls(spark, d, 5).where("h > 1").withColumn("rating", F.when(~F.col("nul"), F.col("x") - 2))
    return reports.verdict_items(v, "it", "rating >= 1")


_METRICS = ["safety", "relevancy", "agent_goal", "helpfulness", "tone"]
_TRAFFIC = "t AS (SELECT doc_id AS sample_id, m AS metric, CASE WHEN (doc_id + length(m)) % 14 > 0 THEN greatest((doc_id * 13 + length(m) * 7) % 101, CASE WHEN m = 'safety' THEN 100 ELSE 45 END * (doc_id % 3 // 2)) / 100 END AS score FROM documents, (SELECT unnest(['safety', 'relevancy', 'agent_goal', 'helpfulness', 'tone']) AS m) WHERE (doc_id * 5 + length(m)) % 17 > 0)"


def _limits(limits: dict) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in limits.items()) + " END"


def _traffic(spark, d):
    i, n = F.col("sample_id"), F.length("metric")
    t = _docs(spark, d).select("sample_id", F.explode(F.array(*[F.lit(m) for m in _METRICS])).alias("metric")).where((i * 5 + n) % 17 > 0)
    floor = F.when(F.col("metric") == "safety", 100).otherwise(45) * F.floor(i % 3 / 2)
    return t.withColumn("score", F.when((i + n) % 14 > 0, F.greatest((i * 13 + n * 7) % 101, floor) / 100))


@query(f"WITH {_TRAFFIC} SELECT sample_id, metric, score, CAST({_limits(verdicts.ALERTS)} AS DOUBLE) AS least FROM t WHERE score < {_limits(verdicts.ALERTS)}")
def production_alerts(spark, d):
    return verdicts.alerts(_traffic(spark, d), verdicts.ALERTS)


@query(f"WITH {_TRAFFIC}, n AS (SELECT sample_id, count(*) FILTER (score >= {_limits(verdicts.PRODUCTION)}) AS good FROM t GROUP BY sample_id) SELECT sample_id, good = {len(verdicts.PRODUCTION)} AS passed, {len(verdicts.PRODUCTION)} - good AS n_failed FROM n")
def production_gate(spark, d):
    return verdicts.gate(_traffic(spark, d), verdicts.PRODUCTION)


@query("SELECT doc_id AS sample_id FROM documents WHERE CAST('0x' || substr(md5('live' || doc_id), 1, 8) AS BIGINT) % 20 < 3")
def sampled_traffic(spark, d):
    return verdicts.sample_traffic(_docs(spark, d).select("sample_id"), "sample_id", 3, 20, "live")


@plain
def rouge_l(spark, d):
    """Over the halves of every text."""
    return derived.pairs(spark, d).select("sample_id", F.round(similarity.rouge_l(F.col("response"), F.col("reference")), 9).alias("rouge"))


@plain
def jaro_winkler(spark, d):
    p = derived.table(spark, d, "part").select("p_partkey", "p_name")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("sample_id"), F.round(similarity.jaro_winkler_similarity(F.col("p_name"), F.col("other")), 6).alias("jaro_winkler"))


@plain
def text_chunks(spark, d):
    """Chunks of at most 100 tokens of every text: how many, the longest, and a digest of all."""
    t = _docs(spark, d).select("sample_id", embedding.split_into_chunks(F.col("text"), 100).alias("chunks"))
    return t.select("sample_id", F.size("chunks").cast("long").alias("n_chunks"), F.array_max(F.transform("chunks", F.length)).cast("long").alias("longest"), F.md5(F.array_join("chunks", "\x1e")).alias("chunks_md5"))


@query(f"WITH {PAIRS}, {_grams('o', 1)} SELECT sample_id, round(CASE WHEN ra = 0 OR rb = 0 OR ov = 0 THEN 0 ELSE 2.0 * ov / (ra + rb) END, 9) AS rouge FROM o")
def stream_scores(spark, d):
    """ROUGE-1 of every text's halves, as a stream."""
    t = monitor.read_stream(spark, f"{d}/documents.parquet").select(F.col("doc_id").alias("sample_id"), F.split("text", " ").alias("w"))
    h = F.floor(F.size("w") / 2).cast("int")
    p = t.where("w is not null").select("sample_id", F.array_join(F.slice("w", 1, F.size("w") - h), " ").alias("response"), F.array_join(F.slice("w", F.size("w") - h + 1, F.size("w")), " ").alias("reference"))
    return monitor.drain(monitor.scored(p.where("response <> '' and reference <> ''")), "scores")


_EVENT_LIMITS = {"error": 20.0, "click": 10.0, "view": 5.0}


@query(f"""WITH e AS (SELECT event_type AS metric, ts, CASE WHEN event_id % 10 > 0 THEN value END AS score FROM events), w AS (SELECT metric, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s, score FROM e)
    SELECT metric, epoch_us(s) AS start_us, epoch_us(s + INTERVAL 6 HOUR) AS end_us, round(avg(score), 6) AS mean, count(*) FILTER (score < {_limits(_EVENT_LIMITS)}) AS n_alerts, count(*) AS n FROM w GROUP BY metric, s HAVING s + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_monitor(spark, d):
    """Closed windows of six hours; those after the watermark are still open."""
    e = monitor.read_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("score"))
    out = monitor.drain(monitor.windowed(e, _EVENT_LIMITS, "6 hours", "1 hour"), "monitor")
    return out.select("metric", *[F.unix_micros(c).alias(f"{c}_us") for c in ("start", "end")], F.round("mean", 6).alias("mean"), "n_alerts", "n")


@query("""WITH e AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id AS conv_id, epoch_us(min(ts)) AS start_us, count(*) AS n_turns, string_agg(event_type, ' ' ORDER BY ts) AS turns FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_conversations(spark, d):
    """Events of a user without a pause of three hours as a conversation."""
    e = monitor.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("user").alias("role"), F.col("event_type").alias("content"))
    out = monitor.drain(monitor.conversations(e, "3 hours", "1 hour"), "conversations")
    return out.select("conv_id", F.unix_micros("start").alias("start_us"), F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["content"]), " ").alias("turns"))
