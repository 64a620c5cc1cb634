"""Registered queries on whole runs: files in, logged calls of judges and embedding models, score tables out."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from gradeworks.functions import text as tx
from gradeworks.jobs.judged import _CONV, MODELS, _docs, _log, _messages, _n, _reply, _rounded, _sql_prompt
from gradeworks.jobs.queries import SQL, query
from gradeworks.operators import embedding, goals, judging, metrics, outcomes, verdicts
from gradeworks.sources import derived, tables
from gradeworks.sources.shared import new_folder

_FIRST = "CASE WHEN role = 'user' THEN turn END"
_LAST = "CASE WHEN role = 'assistant' THEN turn END"


@query(f"""WITH s AS (SELECT conv_id, arg_min(text, {_FIRST}) AS q, arg_max(text, {_LAST}) AS a, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN k = 1 THEN NULL ELSE conv_id END AS sample_id, CASE WHEN k <> 1 THEN md5(coalesce(q, '')) END AS question_md5, CASE WHEN k NOT IN (1, 2) THEN md5(coalesce(a, '')) END AS answer_md5,
        CASE WHEN k NOT IN (1, 2) THEN '{{"n":' || n || ',"s":"' || n || '"}}' END AS arguments,
        CASE k WHEN 1 THEN '{{"sample_id": ' || conv_id || ', "user_input": "' END AS broken, k IN (1, 2) AS unreadable
    FROM (SELECT *, conv_id % 10 AS k FROM s)""")
def sample_files(spark, d):
    """Conversations as samples in JSON lines, some of them cut off or with a text for a number, and read again by the samples' schema."""
    c, i = derived.table(spark, d, "conversations"), F.col("conv_id")
    turn = lambda role: F.when(F.col("role") == role, F.col("turn"))
    s = c.groupBy("conv_id").agg(F.min_by("text", turn("user")).alias("q"), F.max_by("text", turn("assistant")).alias("a"), F.count("*").alias("n"))
    args = F.struct(F.col("n"), F.col("n").cast("string").alias("s"))
    call = F.array(F.struct(F.lit("count").alias("name"), args.alias("arguments")))
    whole = F.to_json(F.struct(i.alias("sample_id"), F.col("q").alias("user_input"), F.col("a").alias("response"), call.alias("tool_calls")))
    typed = F.to_json(F.struct(i.alias("sample_id"), F.col("q").alias("user_input"), F.lit("none").alias("tool_calls")))
    cut = F.concat(F.lit('{"sample_id": '), i.cast("string"), F.lit(', "user_input": "'))
    line = F.when(i % 10 == 1, cut).when(i % 10 == 2, typed).otherwise(whole)
    path = new_folder(spark, "samples")
    s.select(line.alias("value")).write.text(path)
    rows = tables.read_json(spark, path, "samples")
    bad = F.col(tables.BAD).isNotNull()
    made = F.map_entries(F.col("tool_calls")[0]["arguments"])
    told = F.concat(F.lit("{"), F.array_join(F.transform(made, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    known, fits = F.col("sample_id").isNotNull(), ~bad
    return rows.select(
        "sample_id",
        F.when(known, F.md5(F.coalesce("user_input", F.lit("")))).alias("question_md5"),
        F.when(fits, F.md5(F.coalesce("response", F.lit("")))).alias("answer_md5"),
        F.when(fits, told).alias("arguments"),
        F.when(~known, F.col(tables.BAD)).alias("broken"),
        bad.alias("unreadable"),
    )


_STORED = """s AS (SELECT doc_id AS sample_id, m AS metric, (doc_id * 13 + length(m) * 7) % 101 / 100 AS score FROM documents, (SELECT unnest(['safety', 'tone', 'helpfulness']) AS m))"""


@query(f"""WITH {_STORED} SELECT sample_id, metric, CASE WHEN metric = 'tone' THEN round(1 - score, 9) ELSE score END AS score, CASE WHEN metric = 'tone' THEN 'AGAIN' ELSE 'OK' END AS status
    FROM s WHERE metric <> 'tone' OR sample_id % 3 > 0""")
def score_store(spark, d):
    """Three metrics' scores written, one metric computed again for fewer samples and replaced, all read back."""
    metric = F.explode(F.array(*[F.lit(m) for m in ("safety", "tone", "helpfulness")])).alias("metric")
    s = _docs(spark, d).select("sample_id", metric)
    s = s.withColumn("score", (F.col("sample_id") * 13 + F.length("metric") * 7) % 101 / 100).withColumn("status", F.lit("OK"))
    path = new_folder(spark, "scores")
    tables.write_scores(s, path)
    old = tables.read_scores(spark, path, ["tone"]).where("sample_id % 3 > 0")
    # a table can't be replaced by what is read from it
    again = new_folder(spark, "scores")
    tables.write_scores(old.withColumn("score", F.round(1 - F.col("score"), 9)).withColumn("status", F.lit("AGAIN")), again)
    tables.write_scores(tables.read_scores(spark, again), path)
    return tables.read_scores(spark, path)


_ASKED = f"""q AS (SELECT doc_id AS sample_id, model_id, p FROM (SELECT doc_id, {_sql_prompt('aspect', definition="'plain'", user_input="coalesce(lang, '')", response="coalesce(text, '')")} AS p FROM documents), (SELECT 'm' || unnest(range(3)) AS model_id))"""


@query(f"""WITH {_ASKED}, n AS (SELECT *, {_n('p')} AS n FROM q), calls AS (SELECT count(DISTINCT model_id || '|' || md5(p)) AS n_calls FROM q)
    SELECT sample_id, model_id, n % 13 <> 0 AND n % 17 <> 0 AS ok, CASE WHEN n % 13 <> 0 AND n % 17 <> 0 THEN n % 7 > 0 END AS verdict, n_calls FROM n, calls""")
def judge_restart(spark, d):
    """A run that stops after half of the documents and is started again: every distinct prompt is answered once."""
    docs = _docs(spark, d).select("sample_id", F.col("lang").alias("user_input"), F.col("text").alias("response"))
    prompts = judging.fan_out(judging.render_prompts(docs, "aspect", definition="plain").select("sample_id", "prompt"), MODELS)
    judge, log = _reply(lambda n: {"criteria": "c", "verdict": n % 7 > 0, "reasoning": "r"}), _log(spark)
    log.ask(prompts.where("sample_id % 2 = 0"), judge)
    got = judging.parse_responses(log.ask(prompts, judge), "aspect")
    n = F.lit(log.rows()).cast("long")
    return got.select("sample_id", "model_id", "ok", F.col("parsed.verdict").alias("verdict"), n.alias("n_calls"))


def _embedder(texts: pd.Series, models: pd.Series):
    """Four small numbers from a digest of model and text; some calls fail."""
    for t, m in zip(texts, models, strict=True):
        n = int(hashlib.md5(f"{m}|{t}".encode()).hexdigest()[:8], 16)
        yield ValueError("HTTP 500") if n % 19 == 0 else [float((n >> 8 * i) % 256 - 100) for i in range(4)]


EMBEDDERS = ["e0", "e1"]


def _sql_number(model: str, text: str) -> str:
    return f"CAST('0x' || substr(md5({model} || '|' || {text}), 1, 8) AS BIGINT)"


def _sql_dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"(({a} // {256**i}) % 256 - 100.0) * (({b} // {256**i}) % 256 - 100.0)" for i in range(4)) + ")"


#: Sentences by white space after a mark or by line feeds, packed while they fit; a longer one is cut by characters.
_PACKED = """list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'open': '', 's': ''}}, list_transform(list_filter(string_split(replace(regexp_replace({0}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: s <> ''), lambda s: {{'done': CAST([] AS VARCHAR[]), 'open': '', 's': s}})),
    lambda a, x: CASE WHEN length(x.s) > {1} THEN {{'done': list_concat(list_concat(a.done, CASE WHEN a.open = '' THEN CAST([] AS VARCHAR[]) ELSE [a.open] END), list_transform(range(CAST(ceil(length(x.s) / {1}) AS BIGINT)), lambda i: substr(x.s, i * {1} + 1, {1}))), 'open': '', 's': ''}}
        WHEN a.open <> '' AND length(a.open) + 1 + length(x.s) > {1} THEN {{'done': list_append(a.done, a.open), 'open': x.s, 's': ''}}
        ELSE {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.s ELSE a.open || ' ' || x.s END, 's': ''}} END)"""
_CHUNKS = "(CASE WHEN length({0}) <= {1} THEN [{0}] ELSE (SELECT CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END FROM (SELECT " + _PACKED + " AS r)) END)"
MOST = 200


def _norm(v: str) -> str:
    return "(" + " + ".join(f"{v}.v{j} * {v}.v{j}" for j in range(4)) + ")"


_SIDES = f"""h AS (SELECT doc_id AS sample_id, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS response, substr(text, CAST(length(text) // 2 AS BIGINT) + 1) AS reference FROM documents),
    k AS (SELECT * FROM h WHERE regexp_replace(response, '\\s', '', 'g') <> '' AND regexp_replace(reference, '\\s', '', 'g') <> ''),
    w AS (SELECT sample_id, 0 AS side, response AS t FROM k UNION ALL SELECT sample_id, 1, reference FROM k),
    pieces AS (SELECT 'TRUNCATE' AS how, sample_id, side, 0 AS i, substr(t, 1, {3 * MOST}) AS t FROM w UNION ALL SELECT 'FAIL_FAST', sample_id, side, 0, t FROM w
        UNION ALL SELECT 'CHUNK', sample_id, side, unnest(range(len(c))), unnest(c) FROM (SELECT sample_id, side, {_CHUNKS.format('t', 3 * MOST)} AS c FROM w)),
    n AS (SELECT how, sample_id, side, i, m, {_sql_number('m', 't')} AS n FROM pieces, (SELECT unnest(['e0', 'e1']) AS m)),
    bad AS (SELECT DISTINCT how, sample_id, m FROM n WHERE n % 19 = 0),
    v AS (SELECT how, sample_id, m, side, {', '.join(f"avg((n // {256**j}) % 256 - 100) AS v{j}" for j in range(4))} FROM n ANTI JOIN bad USING (how, sample_id, m) GROUP BY ALL),
    s AS (SELECT a.how, a.sample_id, CASE WHEN {_norm('a')} = 0 OR {_norm('b')} = 0 THEN 0 ELSE ({' + '.join(f"a.v{j} * b.v{j}" for j in range(4))}) / (sqrt({_norm('a')}) * sqrt({_norm('b')})) END AS s FROM v a JOIN v b ON a.how = b.how AND a.sample_id = b.sample_id AND a.m = b.m WHERE a.side = 0 AND b.side = 1)"""


@query(f"""WITH {_SIDES} SELECT h.sample_id, how, CASE WHEN k.sample_id IS NULL THEN 0.0 ELSE round(avg(s), 9) END AS score, CASE WHEN k.sample_id IS NULL THEN 'ZERO_INPUT' WHEN count(s) = 0 THEN 'FAILED' ELSE 'OK' END AS status
    FROM h CROSS JOIN (SELECT unnest(['CHUNK', 'TRUNCATE', 'FAIL_FAST']) AS how) LEFT JOIN k USING (sample_id) LEFT JOIN s USING (sample_id, how) GROUP BY h.sample_id, how, k.sample_id""")
def semantic_similarity_texts(spark, d):
    """The halves of every text by all three strategies for long texts, over two embedding models; every distinct text is sent once."""
    n = F.floor(F.length("text") / 2).cast("int")
    halves = _docs(spark, d).select("sample_id", F.substring(F.col("text"), F.lit(1), n).alias("response"), F.substring(F.col("text"), n + 1, F.length("text")).alias("reference"))
    log, out = embedding.vector_log(spark, new_folder(spark, "vectors")), None
    for how in ("CHUNK", "TRUNCATE", "FAIL_FAST"):
        by_model = embedding.semantic_similarity_of_texts(halves, log, _embedder, EMBEDDERS, how, MOST)
        one = _rounded(outcomes.with_outcome(halves, verdicts.over_models(by_model), "semantic_similarity")).withColumn("how", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out.select("sample_id", "how", "score", "status")


@query(f"""WITH q AS (SELECT doc_id AS sample_id, lang AS own, m, i, CASE WHEN doc_id % 3 = 0 AND i = 1 THEN ' ' ELSE coalesce(source, '') || ' ' || (doc_id + i) % 50 END AS question, CASE WHEN (doc_id + i) % 4 = 0 OR doc_id % 11 = 0 THEN 1 ELSE 0 END AS non
        FROM documents, (SELECT 'm' || unnest(range(2)) AS m), (SELECT unnest(range(3)) AS i)),
    t AS (SELECT DISTINCT sample_id, e, t, {_sql_number('e', 't')} AS n FROM (SELECT sample_id, own AS t FROM q WHERE own IS NOT NULL UNION ALL SELECT sample_id, question FROM q WHERE trim(question) <> ''), (SELECT unnest(['e0', 'e1']) AS e)),
    g AS (SELECT sample_id, min(e) AS e FROM (SELECT sample_id, e FROM t GROUP BY ALL HAVING NOT bool_or(n % 19 = 0)) SEMI JOIN (SELECT doc_id AS sample_id FROM documents WHERE lang IS NOT NULL) USING (sample_id) GROUP BY sample_id),
    c AS (SELECT q.sample_id, q.m, q.non, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN {_sql_dot('a.n', 'b.n')} END AS xy, {_sql_dot('a.n', 'a.n')} AS xx, {_sql_dot('b.n', 'b.n')} AS yy
        FROM q LEFT JOIN g USING (sample_id) LEFT JOIN t a ON a.sample_id = q.sample_id AND a.e = g.e AND a.t = q.own LEFT JOIN t b ON b.sample_id = q.sample_id AND b.e = g.e AND b.t = q.question)
    SELECT sample_id, m AS model_id, round(CASE WHEN min(non) = 1 THEN 0.0 ELSE avg(CASE WHEN xx * yy = 0 THEN 0 ELSE xy / (sqrt(xx) * sqrt(yy)) END) END, 9) AS score FROM c GROUP BY sample_id, m""")
def response_relevancy_texts(spark, d):
    """Questions made of each document's fields against its language's name, by the first embedding model that answered every call of the sample."""
    i, n = F.col("sample_id"), F.col("q_idx")
    samples = _docs(spark, d).select("sample_id", F.col("lang").alias("user_input"), "source")
    q = judging.fan_out(samples, ["m0", "m1"]).withColumn("q_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    text = F.when((i % 3 == 0) & (n == 1), F.lit(" ")).otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), ((i + n) % 50).cast("string")))
    q = q.select("sample_id", "model_id", "q_idx", text.alias("question"), F.when(((i + n) % 4 == 0) | (i % 11 == 0), 1).otherwise(0).alias("noncommittal"))
    log = embedding.vector_log(spark, new_folder(spark, "vectors"))
    return _rounded(embedding.response_relevancy_of_texts(samples, q, log, _embedder, EMBEDDERS))


def _sql_goal(prompt: str, name: str, source: str) -> str:
    return f"{name} AS (SELECT sample_id, pos, {_n('p')} AS n FROM (SELECT sample_id, pos, 'm' || pos AS model_id, {prompt} AS p FROM {source}, (SELECT unnest(range(3)) AS pos)) WHERE n % 13 <> 0 AND n % 17 <> 0)"


@query(f"""WITH {_CONV}, r AS (SELECT *, CASE WHEN sample_id % 3 = 0 THEN 'goal ' || sample_id WHEN sample_id % 3 = 1 THEN '' END AS reference FROM v),
    {_sql_goal(_sql_prompt('inferred_goal', conversation='conversation'), 'i', "(SELECT * FROM r WHERE coalesce(reference, '') = '')")},
    f AS (SELECT sample_id, arg_min('wants ' || n % 9, pos) AS goal FROM i WHERE n % 10 > 0 GROUP BY sample_id),
    g AS (SELECT sample_id, conversation, coalesce(nullif(reference, ''), goal) AS goal, coalesce(reference, '') = '' AS inferred FROM r LEFT JOIN f USING (sample_id)),
    {_sql_goal(_sql_prompt('goal', goal='goal', conversation='conversation'), 'j', '(SELECT * FROM g WHERE goal IS NOT NULL)')}
    SELECT g.sample_id, g.goal, CASE WHEN g.goal IS NOT NULL THEN inferred END AS inferred, round(avg(CASE WHEN n % 4 > 0 THEN 1.0 ELSE 0.0 END) FILTER (n IS NOT NULL), 9) AS score, CASE WHEN count(n) = 0 THEN 'FAILED' ELSE 'OK' END AS status
    FROM g LEFT JOIN j ON j.sample_id = g.sample_id GROUP BY g.sample_id, g.goal, inferred""")
def goal_accuracy_run(spark, d):
    """Conversations with a reference, an empty one or none: the last two fall back to goals that models infer."""
    i = F.col("sample_id")
    reference = F.when(i % 3 == 0, F.concat(F.lit("goal "), i.cast("string"))).when(i % 3 == 1, F.lit(""))
    samples = judging.format_conversation(_messages(spark, d)).withColumn("reference", reference)

    def judge(prompts: pd.Series, models: pd.Series):
        make = _reply(lambda n: {"inferredGoal": f"wants {n % 9}" if n % 10 else None, "goalAchieved": n % 4 > 0, "reasoning": "r"})
        for p, r in zip(prompts, make(prompts, models), strict=True):
            known = None if isinstance(r, Exception) or r == "sorry" else json.loads(r)
            yield r if known is None else json.dumps({k: known[k] for k in ("inferredGoal" if p.startswith("What did") else "goalAchieved", "reasoning")})

    return _rounded(goals.goal_accuracy(samples, _log(spark), judge, MODELS))


@query("SELECT doc_id AS sample_id, CASE WHEN doc_id % 12 > 0 THEN doc_id * 13 % 101 / 100 END AS score, CASE WHEN doc_id % 12 = 0 THEN 3 WHEN doc_id * 13 % 101 >= 90 THEN 0 WHEN doc_id * 13 % 101 >= 70 THEN 1 WHEN doc_id * 13 % 101 >= 50 THEN 2 ELSE 3 END AS level FROM documents")
def level_index(spark, d):
    s = _docs(spark, d).select("sample_id", F.when(F.col("sample_id") % 12 > 0, F.col("sample_id") * 13 % 101 / 100).alias("score"))
    return s.withColumn("level", verdicts.score_level_index(F.col("score")))


_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zа-яё0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id AS sample_id, {_TOKENS} AS w, lower(text) AS t FROM documents WHERE text IS NOT NULL)
    SELECT sample_id, greatest(len(w) - 2, 0) AS n_words, md5(array_to_string(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')), chr(30))) AS words_md5,
        greatest(length(t) - 3, 0) AS n_chars, md5(array_to_string(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)), chr(30))) AS chars_md5 FROM t""")
def text_ngrams(spark, d):
    """Three words and four characters in a row, of every whole text."""
    t = _docs(spark, d).where("text is not null")
    w, c = tx.word_ngrams(tx.tokenize(F.col("text")), 3, "\x1e"), tx.char_ngrams(F.col("text"), 4, "\x1e")
    t = t.select("sample_id", w.alias("w"), c.alias("c"))
    return t.select("sample_id", F.col("w.n").alias("n_words"), F.md5("w.joined").alias("words_md5"), F.col("c.n").alias("n_chars"), F.md5("c.joined").alias("chars_md5"))


@query("""WITH h AS (SELECT doc_id AS sample_id, coalesce(lang, '') AS lang, list_value(substr(text, 1, CAST(length(text) // 2 AS BIGINT)), substr(text, CAST(length(text) // 2 AS BIGINT) + 1)) AS c FROM documents WHERE text IS NOT NULL)
    SELECT sample_id, md5(c[1] || chr(10) || chr(10) || c[2]) AS contexts_md5, '1. ' || lang || chr(10) || '2. ' || sample_id || chr(10) AS numbered, lang || chr(10) || sample_id AS plain FROM h""")
def prompt_parts(spark, d):
    """Contexts and statements as prompts hold them."""
    n = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.substring(F.col("text"), F.lit(1), n), F.substring(F.col("text"), n + 1, F.length("text")))
    items = F.array(F.coalesce("lang", F.lit("")), F.col("sample_id").cast("string"))
    t = _docs(spark, d).where("text is not null")
    parts = [judging.format_statements(items).alias("numbered"), judging.format_statements(items, False).alias("plain")]
    return t.select("sample_id", F.md5(tx.join_contexts(halves, "\n\n")).alias("contexts_md5"), *parts)


_WORDS = "unnest(string_split({0}, ' '))"


@query(f"""WITH h AS (SELECT doc_id, lang, text, CAST(length(text) // 2 AS BIGINT) AS k FROM documents WHERE text IS NOT NULL),
    e AS (SELECT coalesce(lang, '') AS sample_id, 'm' || doc_id % 2 AS model_id, {_WORDS.format("substr(text, 1, k)")} AS e, 1 AS r FROM h UNION ALL SELECT coalesce(lang, ''), 'm' || doc_id % 2, {_WORDS.format("substr(text, k + 1)")}, 0 FROM h),
    n AS (SELECT sample_id, model_id, lower(regexp_replace(e, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS e, max(r) AS r, max(1 - r) AS c FROM e GROUP BY ALL)
    SELECT sample_id, model_id, round(CASE WHEN sum(r) > 0 THEN sum(r * c) / sum(r) ELSE 0 END, 9) AS score, CAST(sum(r) - sum(r * c) AS BIGINT) AS n_missing FROM n WHERE e <> '' GROUP BY ALL""")
def entity_recall_large(spark, d):
    """All words of all first halves of a language's texts as the reference's names, those of the second halves as the context's."""
    t = derived.table(spark, d, "documents").where("text is not null")
    n = F.floor(F.length("text") / 2).cast("int")
    side = lambda s, x: F.struct(F.lit(s).alias("side"), F.split(x, " ").alias("w"))
    halves = F.explode(F.array(side("reference", F.substring(F.col("text"), F.lit(1), n)), side("context", F.substring(F.col("text"), n + 1, F.length("text")))))
    e = t.select(F.coalesce("lang", F.lit("")).alias("sample_id"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model_id"), halves.alias("h"))
    e = e.select("sample_id", "model_id", "h.side", F.explode("h.w").alias("entity"))
    return _rounded(verdicts.entity_recall_of_rows(verdicts.entity_flags(e)))


@query(f"""WITH d AS (SELECT doc_id AS sample_id, lang, CASE WHEN doc_id % 6 > 0 THEN text END AS response FROM documents),
    q AS (SELECT sample_id, 'm' || pos AS model_id, it, 'How short is this ' || coalesce(lang, '') || ' text?' || chr(10) || response AS p FROM d, (SELECT unnest(range(3)) AS pos), (SELECT unnest(range(2)) AS it) WHERE length(response) > 0),
    n AS (SELECT *, {_n('p')} AS n FROM q), g AS (SELECT sample_id, model_id, avg((n % 11) / 10.0) AS s FROM n WHERE n % 13 <> 0 AND n % 17 <> 0 GROUP BY ALL), b AS (SELECT sample_id, median(s) AS s FROM g GROUP BY sample_id),
    a AS (SELECT sample_id, avg(CASE WHEN n % 7 > 0 THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT *, {_n('p')} AS n FROM (SELECT sample_id, 'm' || pos AS model_id, {_sql_prompt('aspect', definition="'plain'", user_input="coalesce(lang, '')", response="coalesce(response, '')")} AS p FROM d, (SELECT unnest(range(3)) AS pos))) WHERE n % 13 <> 0 AND n % 17 <> 0 GROUP BY sample_id)
    SELECT d.sample_id, 'brevity' AS metric, CASE WHEN coalesce(response, '') = '' THEN 0.0 ELSE round(b.s, 9) END AS score, CASE WHEN coalesce(response, '') = '' THEN 'ZERO_INPUT' WHEN b.s IS NULL THEN 'FAILED' ELSE 'OK' END AS status FROM d LEFT JOIN b USING (sample_id)
    UNION ALL SELECT d.sample_id, 'plain', round(a.s, 9), CASE WHEN a.s IS NULL THEN 'FAILED' ELSE 'OK' END FROM d LEFT JOIN a USING (sample_id)""")
def own_metrics(spark, d):
    """Two metrics of a caller's own, evaluated together: one asks twice, takes the median of models and scores empty responses zero."""
    i = F.col("sample_id")
    samples = _docs(spark, d).select("sample_id", F.col("lang").alias("user_input"), F.when(i % 6 > 0, F.col("text")).alias("response"))
    brevity = metrics.Metric(
        "brevity",
        "How short is this {user_input} text?\n{response}",
        "score double, reasoning string",
        lambda p: p.groupBy("sample_id", "model_id").agg(F.avg("parsed.score").alias("score")),
        needs=("response",),
        outcome="ZERO_INPUT",
        iterations=2,
        over_models="median",
    )
    plain = metrics.Metric("plain", judging.TEMPLATES["aspect"].replace("{definition}", "plain"), judging.SCHEMAS["aspect"], lambda p: verdicts.aspect_critic(p.select("sample_id", "model_id", F.col("parsed.verdict").alias("verdict"))))

    def judge(prompts: pd.Series, models: pd.Series):
        short, other = (_reply(f) for f in (lambda n: {"score": n % 11 / 10, "reasoning": "r"}, lambda n: {"criteria": "c", "verdict": n % 7 > 0, "reasoning": "r"}))
        for p, m in zip(prompts, models, strict=True):
            yield from (short if p.startswith("How short") else other)([p], [m])

    return _rounded(metrics.evaluate(samples, [brevity, plain], _log(spark), judge, MODELS))


SQL["text_chunks"] = f"""SELECT doc_id AS sample_id, len(c) AS n_chunks, list_max(list_transform(c, lambda x: length(x))) AS longest, md5(array_to_string(c, chr(30))) AS chunks_md5
    FROM (SELECT doc_id, {_CHUNKS.format('text', 300)} AS c FROM documents)"""
