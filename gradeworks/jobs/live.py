"""Registered queries on streams with state, and on scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.jobs.judged import _docs, _limits, _traffic, _TRAFFIC
from gradeworks.jobs.queries import query
from gradeworks.operators import scorecards, verdicts
from gradeworks.sources import derived
from gradeworks.sources.shared import new_folder
from gradeworks.streaming import live, monitor

_LAST = "(SELECT max(ts) FROM events)"


@query(f"""WITH q AS (SELECT event_id AS request_id, ts, event_id % 9 = 0 AS lost, (event_id * 7) % 90 AS wait FROM events)
    SELECT request_id, NOT lost AND wait <= 60 AS ok, CASE WHEN NOT lost AND wait <= 60 THEN '{{"score": ' || request_id % 3 || '}}' END AS response_json, CASE WHEN lost OR wait > 60 THEN 'timeout' END AS error
    FROM q WHERE ts < {_LAST} - INTERVAL 200 MINUTE""")
def live_judging(spark, d):
    """Requests and replies as two streams: some replies come late, some twice, some never."""
    i, wait = F.col("event_id"), (F.col("event_id") * 7) % 90
    t = derived.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = F.explode(F.when(i % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    where = new_folder(spark, "live")
    t.select(i.alias("request_id"), "ts", twice.alias("copy")).drop("copy").write.parquet(f"{where}/requests")
    reply = F.concat(F.lit('{"score": '), (i % 3).cast("string"), F.lit("}"))
    t.where("event_id % 9 <> 0").select(i.alias("request_id"), (F.col("ts") + F.make_dt_interval(mins=wait)).alias("reply_ts"), reply.alias("response_json"), twice.alias("copy")).drop("copy").write.parquet(f"{where}/replies")
    both = live.settle(monitor.read_stream(spark, f"{where}/requests"), monitor.read_stream(spark, f"{where}/replies"), "60 MINUTES", "2 hours")
    settled = t.agg((F.max("ts") - F.expr("INTERVAL 200 MINUTES")).alias("until"))
    out = monitor.drain(both, "judged")
    return out.join(F.broadcast(settled), F.col("ts") < F.col("until")).select("request_id", "ok", "response_json", "error")


_GONE = "conv_id % 7 = 3 AND turn = 1"


@query(f"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 3 > 0 AS closing FROM conversations),
    k AS (SELECT * FROM m WHERE NOT ({_GONE}))
    SELECT conv_id, CASE WHEN count(*) = max(CASE WHEN closing THEN turn END) + 1 THEN 'CLOSED' ELSE 'TIMED_OUT' END AS how, count(*) AS n_turns, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS turns_md5 FROM k GROUP BY conv_id""")
def live_dialogs(spark, d):
    """Messages of all conversations shuffled over four batches, some repeated, some lost; a last message moves the watermark past all others."""
    c = derived.table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    m = c.join(last, "conv_id").where(f"NOT ({_GONE})").select(
        "conv_id",
        "turn",
        (start + F.make_dt_interval(mins=(F.col("conv_id") % 1000 + F.col("turn")).cast("int"))).alias("ts"),
        "role",
        F.coalesce("text", F.lit("")).alias("content"),
        ((F.col("turn") == F.col("last")) & (F.col("conv_id") % 3 > 0)).alias("closing"),
    )
    where = new_folder(spark, "messages")
    twice = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    m.withColumn("copy", F.explode(twice)).repartition(4, F.xxhash64("conv_id", "turn", "copy")).drop("copy").write.parquet(where)
    end = spark.sql("SELECT -1L AS conv_id, 0 AS turn, TIMESTAMP '2024-06-01 00:00:00' AS ts, 'user' AS role, '' AS content, false AS closing")
    end.select(*[F.col(f.name).cast(f.dataType) for f in m.schema.fields]).write.mode("append").parquet(where)
    out = monitor.drain(live.dialogs(monitor.read_stream(spark, where, 1), 3600, "30 days"), "dialogs").where("conv_id >= 0")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "\n")
    return out.select("conv_id", "how", F.size("turns").cast("long").alias("n_turns"), F.md5(text).alias("turns_md5"))


@query(f"WITH {_TRAFFIC}, n AS (SELECT sample_id, count(*) FILTER (score >= {_limits(verdicts.PRODUCTION)}) AS good FROM t GROUP BY sample_id) SELECT sample_id, good = {len(verdicts.PRODUCTION)} AS passed, {len(verdicts.PRODUCTION)} - good AS n_failed FROM n")
def live_gate(spark, d):
    """Scores that come metric by metric in several batches, the first ones wrong and put right later; a batch is replayed at the end."""
    t = _traffic(spark, d).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    where = new_folder(spark, "traffic")
    wrong = t.where("metric = 'safety'").withColumn("score", F.lit(0.0))
    wrong.coalesce(1).write.mode("append").parquet(f"{where}/in")
    for m in ("metric in ('tone', 'agent_goal')", "metric in ('helpfulness', 'relevancy')"):
        t.where(m).coalesce(1).write.mode("append").parquet(f"{where}/in")
    late = t.where("metric = 'safety'").withColumn("ts", F.expr("ts + INTERVAL 1 HOUR"))
    late.coalesce(1).write.mode("append").parquet(f"{where}/in")
    sink = live.GateSink(f"{where}/out", verdicts.PRODUCTION)
    live.run_into(monitor.read_stream(spark, f"{where}/in", 1), sink, f"{where}/state")
    sink(wrong, 0)  # again what was in the first batch
    return sink.gates(spark)


_KEYS = ["metric", "model_id", "lang"]
_SETS = [_KEYS, ["metric", "model_id"], ["metric", "lang"], ["metric"], []]
_CARD = """s AS (SELECT m AS metric, 'm' || pos AS model_id, lang, ((doc_id * 13 + pos * 29 + length(m) * 7) % 1009) / 1008 AS score FROM documents, (SELECT unnest(range(3)) AS pos), (SELECT unnest(['safety', 'tone']) AS m) WHERE (doc_id * 17 + pos * 5) % 11 <> 0)"""


def _card_scores(spark, d):
    i, pos, m = F.col("sample_id"), F.col("pos"), F.col("metric")
    s = _docs(spark, d).select("sample_id", "lang", F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("pos"))
    s = s.withColumn("metric", F.explode(F.array(F.lit("safety"), F.lit("tone")))).where((i * 17 + pos * 5) % 11 != 0)
    return s.select("metric", F.concat(F.lit("m"), pos.cast("string")).alias("model_id"), "lang", ((i * 13 + pos * 29 + F.length(m) * 7) % 1009 / 1008).alias("score"))


def _sql_sets() -> str:
    return "GROUPING SETS (" + ", ".join("(" + ", ".join(s) + ")" for s in _SETS) + ")"


_SET = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in _KEYS) + ")"
_B = "least(greatest(CAST(floor(score * 1000) AS BIGINT), 0), 999)"


@query(f"""WITH {_CARD}, x AS (SELECT {_SET} AS grouping, metric, model_id, lang, count(*) AS n, round(avg(score), 9) AS mean, {', '.join(f"quantile_disc(score, {q}) AS x{round(q * 100)}" for q in scorecards.QUANTILES)}, {', '.join(f"quantile_disc({_B}, {q}) AS b{round(q * 100)}" for q in scorecards.QUANTILES)} FROM s GROUP BY {_sql_sets()})
    SELECT grouping, metric, model_id, lang, n, mean, {', '.join(f"(b{k} + 1) / 1000 AS q{k}, round(x{k}, 9) AS exact{k}" for k in (round(q * 100) for q in scorecards.QUANTILES))} FROM x""")
def scorecard(spark, d):
    """Five groupings from merged sketches of two parts of the scores, beside exact quantiles."""
    s = _card_scores(spark, d)
    parts = [scorecards.sketch(s.where(F.xxhash64("score") % 2 == k if k == 0 else F.xxhash64("score") % 2 != 0), _KEYS) for k in (0, 1)]
    card = scorecards.scorecard(scorecards.merge(parts[0].unionByName(parts[1]), _KEYS), _SETS, _KEYS)
    true = scorecards.exact(s, _SETS, _KEYS)
    names = [f"q{round(q * 100)}" for q in scorecards.QUANTILES]
    true = true.select("grouping", *[F.coalesce(k, F.lit("")).alias(f"t_{k}") for k in _KEYS], *[F.round(n, 9).alias(n.replace("q", "exact")) for n in names])
    on = [F.coalesce(F.col(k), F.lit("")) == F.col(f"t_{k}") for k in _KEYS]
    both = card.join(true.withColumnRenamed("grouping", "t_grouping"), [F.col("grouping") == F.col("t_grouping"), *on])
    return both.select("grouping", *_KEYS, "n", F.round("mean", 9).alias("mean"), *names, *[n.replace("q", "exact") for n in names])
