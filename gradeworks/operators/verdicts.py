"""Scores from tables of model verdicts, one row per sample and model; and their aggregation over models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["sample_id", "model_id"]


def aspect_critic(v: DataFrame) -> DataFrame:
    """``verdict`` of each iteration: 1 if more than half are true, null counts as false, a tie as 0."""
    return v.groupBy(KEY).agg((F.avg(F.coalesce("verdict", F.lit(False)).cast("int")) > 0.5).cast("double").alias("score"))


def simple_criteria(v: DataFrame, low: float = 0, high: float = 5) -> DataFrame:
    """Median over iterations of scores clamped to the range and scaled to [0, 1]; bad numbers count as 0."""
    x = F.col("score").cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | F.lit(high <= low)
    scaled = F.when(bad, 0.0).otherwise((F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)) - low) / ((high - low) or 1))
    return v.groupBy(KEY).agg(F.median(scaled).alias("score"))


def rubrics_score(v: DataFrame) -> DataFrame:
    """The level that was chosen, as it is; a null level counts as 0."""
    return v.groupBy(KEY).agg(F.avg(F.coalesce("score", F.lit(0))).alias("score"))


def rubric_range(rubric: Column) -> Column:
    """Struct (low, high) of the levels in a rubric's keys, of those above 0; 1 and 5 without any."""
    level = F.filter(F.transform(F.map_keys(F.coalesce(rubric, F.create_map().cast("map<string,string>"))), lambda k: F.regexp_replace(k, "[^0-9]", "").try_cast("int")), lambda x: x > 0)
    return F.struct(F.coalesce(F.array_min(level), F.lit(1)).alias("low"), F.coalesce(F.array_max(level), F.lit(5)).alias("high"))


def normalize_rubric(score: Column, rubric: Column) -> Column:
    """Where a level lies on its rubric's scale, 0 to 1; 0 on a scale of one level."""
    r = rubric_range(rubric)
    return F.when(r["high"] > r["low"], (score - r["low"]) / (r["high"] - r["low"])).otherwise(F.when(score.isNotNull(), 0.0))


def faithfulness(v: DataFrame) -> DataFrame:
    """Share of statements with flag 1."""
    return v.groupBy(KEY).agg(F.avg(F.when(F.col("flag") == 1, 1.0).otherwise(0.0)).alias("score"))


def context_recall(v: DataFrame) -> DataFrame:
    """Sum of flags over number of statements; a null flag fails the sample."""
    return v.groupBy(KEY).agg(F.when(F.count("flag") == F.count("*"), F.sum("flag") / F.count("*")).alias("score"))


def precision_at_k(v: DataFrame) -> DataFrame:
    """``relevant`` by ``ctx_idx``: share of relevant contexts up to each rank, 0 where the context isn't relevant."""
    hit = F.coalesce("relevant", F.lit(False)).cast("int")
    w = Window.partitionBy(KEY).orderBy("ctx_idx").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("precision_at", F.when(hit == 1, F.sum(hit).over(w) / F.count("*").over(w)).otherwise(0.0))


def context_precision(v: DataFrame) -> DataFrame:
    """Average precision; nothing relevant gives 0."""
    hits = F.sum(F.coalesce("relevant", F.lit(False)).cast("int"))
    return precision_at_k(v).groupBy(KEY).agg(F.when(hits == 0, 0.0).otherwise(F.sum("precision_at") / hits).alias("score"))


def precision_strategy(reference: Column, requested: str | None = None) -> Column:
    """REFERENCE or RESPONSE: what contexts are compared with; a blank reference can't be asked for."""
    has = F.coalesce(F.length(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", "")) > 0, F.lit(False))
    return F.lit("RESPONSE") if requested == "RESPONSE" else F.when(has, "REFERENCE").otherwise("RESPONSE")


def missing_entities(e: DataFrame) -> DataFrame:
    """The names of ``reference`` that ``context`` lacks, sorted; both normalized."""
    none = F.array().cast("array<string>")
    return e.select(*KEY, F.array_sort(F.array_except(F.coalesce("reference", none), F.coalesce("context", none))).alias("missing"))


def entity_recall(e: DataFrame) -> DataFrame:
    """``reference`` and ``context`` arrays of normalized names: share of the reference's that the context has."""
    n = F.size(F.coalesce("reference", F.array().cast("array<string>")))
    return e.select(*KEY, F.when(n <= 0, 0.0).otherwise(F.coalesce(F.size(F.array_intersect("reference", "context")), F.lit(0)) / n).alias("score"), F.size(F.array_except("reference", "context")).alias("n_missing"))


def entity_flags(entities: DataFrame) -> DataFrame:
    """(sample_id, model_id, entity, in_reference, in_context) for each normalized name of ``entities`` (side reference or context, entity).

    Names are told apart by the shuffle's key itself, so a sample with very many is spread over all tasks, and a name
    that is repeated very often is put together before the shuffle.
    """
    name = F.lower(F.regexp_replace("entity", r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    rows = entities.withColumn("entity", name).where(F.length("entity") > 0)
    has = lambda s: F.max(F.col("side") == s)
    return rows.groupBy(*KEY, "entity").agg(has("reference").alias("in_reference"), has("context").alias("in_context"))


def entity_recall_of_rows(flags: DataFrame) -> DataFrame:
    """``entity_recall`` from ``entity_flags``: score and n_missing, by partial sums. Without names of the reference the score is 0."""
    ref = F.col("in_reference").cast("long")
    both = (F.col("in_reference") & F.col("in_context")).cast("long")
    n, found = F.sum(ref), F.sum(both)
    return flags.groupBy(*KEY).agg(F.when(n > 0, found / n).otherwise(0.0).alias("score"), (n - found).alias("n_missing"))


def missing_entity_rows(flags: DataFrame) -> DataFrame:
    """(sample_id, model_id, entity) of the reference's names that the context lacks."""
    return flags.where("in_reference and not in_context").select(*KEY, "entity")


def noise_sensitivity(answer: DataFrame, to_reference: DataFrame, to_answer: DataFrame, relevant: bool = True) -> DataFrame:
    """How much of the answer is wrong because of contexts; 0 is good.

    ``answer``: stmt_idx, verdict (the reference supports it); ``to_reference``, ``to_answer``: ctx_idx, stmt_idx,
    verdict (the context supports the statement of the reference, of the answer). Missing verdicts are false.
    """
    good = to_reference.groupBy(*KEY, "ctx_idx").agg(F.max(F.coalesce("verdict", F.lit(False))).alias("good"))
    both = to_answer.join(good, [*KEY, "ctx_idx"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    has = F.coalesce("verdict", F.lit(False))
    side = both.groupBy(*KEY, "stmt_idx").agg(F.max(has & F.col("good")).alias("by_good"), F.max(has & ~F.col("good")).alias("by_bad"))
    rows = answer.join(side, [*KEY, "stmt_idx"], "left").select(*KEY, (~F.coalesce("verdict", F.lit(False))).alias("wrong"), F.coalesce("by_good", F.lit(False)).alias("g"), F.coalesce("by_bad", F.lit(False)).alias("b"))
    hit = F.col("wrong") & (F.col("g") if relevant else F.col("b") & ~F.col("g"))
    return rows.groupBy(KEY).agg(F.avg(hit.cast("int")).alias("score"))


def factual_correctness(c: DataFrame, mode: str = "F1") -> DataFrame:
    """Claims by ``side`` (response, reference) with a ``verdict`` text: supported shares as precision and recall."""
    yes = (F.upper("verdict") == "SUPPORTED").cast("int")
    p, r = (F.coalesce(F.avg(F.when(F.col("side") == s, F.coalesce(yes, F.lit(0)))), F.lit(0.0)) for s in ("response", "reference"))
    g = c.groupBy(KEY).agg(p.alias("p"), r.alias("r"))
    f = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return g.select(*KEY, {"F1": f, "PRECISION": F.col("p"), "RECALL": F.col("r")}[mode].alias("score"))


def hallucination_rate(c: DataFrame) -> DataFrame:
    """Share of claims that are hallucinated or contradicted; 0 is good."""
    return c.groupBy(KEY).agg(F.avg(F.coalesce(F.upper("verdict").isin("HALLUCINATED", "CONTRADICTED"), F.lit(False)).cast("int")).alias("score"))


def answer_correctness(factual: DataFrame, semantic: DataFrame, wf: float = 0.75, ws: float = 0.25) -> DataFrame:
    """Weighted mean per sample of two scores; a missing one counts as 0."""
    both = factual.select("sample_id", F.col("score").alias("f")).join(semantic.select("sample_id", F.col("score").alias("s")), "sample_id", "full_outer")
    mean = (F.coalesce("f", F.lit(0.0)) * wf + F.coalesce("s", F.lit(0.0)) * ws) / (wf + ws) if wf + ws > 0 else F.lit(0.0)
    return both.select("sample_id", mean.alias("score"))


def _half(rating: Column) -> Column:
    """A rating of 0 to 2 as a score of 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rating / 2))


def answer_accuracy(r: DataFrame) -> DataFrame:
    """Mean of ratings 0 to 2 halved; if a second ``round`` has any, they replace all of the first. Null ratings are left out."""
    rated = r.withColumn("x", F.when(F.col("score").isNotNull(), _half(F.col("score"))))
    return rated.groupBy("sample_id").agg(F.coalesce(*[F.avg(F.when(F.col("round") == k, F.col("x"))) for k in (2, 1)]).alias("score")).where("score is not null")


def dual_judge_seed(r: DataFrame) -> DataFrame:
    """sample_id, rating, reasoning for the prompt of a second round: the first round's mean rounded to 0, 1 or 2, and its first model's reasoning."""
    first = r.where((F.col("round") == 1) & F.col("score").isNotNull())
    return first.groupBy("sample_id").agg(F.floor(F.avg(_half(F.col("score"))) * 2 + 0.5).cast("int").alias("rating"), F.min_by("reasoning", "model_pos").alias("reasoning"))


def groundedness_shortcut(response: Column, contexts: Column) -> Column:
    """1.0 if the response is one of the contexts, or part of them joined by empty lines (case aside); null if a judge must decide."""
    strip = lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    own = F.lower(strip(response))
    same = F.exists(contexts, lambda c: F.coalesce(F.lower(strip(c)) == own, F.lit(False)))
    return F.when(same | F.lower(F.array_join(contexts, "\n\n")).contains(own), 1.0)


def response_groundedness(samples: DataFrame, ratings: DataFrame, shortcuts: bool = True) -> DataFrame:
    """sample_id, score: the shortcut if it decides, else the mean of ratings 0 to 2 halved.

    Samples without contexts have no row; an empty response scores 0 with shortcuts on.
    """
    s = samples.where(F.col("contexts").isNotNull() & (F.size("contexts") > 0))
    quick = F.when(F.coalesce(F.length("response"), F.lit(0)) == 0, 0.0).otherwise(groundedness_shortcut(F.col("response"), F.col("contexts"))) if shortcuts else F.lit(None).cast("double")
    judged = ratings.where("score is not null").groupBy("sample_id").agg(F.avg(_half(F.col("score"))).alias("judged"))
    return s.select("sample_id", quick.alias("quick")).join(judged, "sample_id", "left").select("sample_id", F.coalesce("quick", "judged").alias("score")).where("score is not null")


def agent_goal(v: DataFrame) -> DataFrame:
    """1 if the goal was reached, else 0; null counts as not."""
    return v.select(*KEY, F.coalesce("goal_achieved", F.lit(False)).cast("double").alias("score"))


def context_relevance(r: DataFrame) -> DataFrame:
    """Mean over contexts of the mean over models."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 2))
    return r.groupBy("sample_id", "item_idx").agg(F.avg(x).alias("s")).groupBy("sample_id").agg(F.avg("s").alias("score"))


def tool_calls_strict(calls: DataFrame) -> DataFrame:
    """Calls of ``side`` actual and reference, with name and ``args`` (sorted entries as text): multiset match without order."""
    n = calls.groupBy("sample_id", "name", "args").agg(*[F.sum((F.col("side") == s).cast("long")).alias(s) for s in ("actual", "reference")])
    g = n.groupBy("sample_id").agg(F.sum(F.least("actual", "reference")).alias("tp"), F.sum("actual").alias("a"), F.sum("reference").alias("r"))
    return _f_of_calls(g)


def pair_calls(actual: list, reference: list, threshold: float) -> list[float]:
    """Score of each actual call (name, arguments) with the reference call it takes, or 0 if it takes none.

    In order, each call takes the free reference call of its name whose arguments it matches best, the
    earliest among equals, if the share of matching arguments reaches the threshold.
    """
    free, out = list(reference), []
    for name, own in actual:
        best, score = None, 0.0
        for i, (other, want) in enumerate(free):
            if other == name:
                hit = sum(own.get(k) is not None and own.get(k) == v for k, v in want.items())
                x = hit / len(want) if want else 0.5 if own else 1.0
                if x > score:
                    best, score = i, x
        if best is not None and score >= threshold:
            free.pop(best)
            out.append(score)
        else:
            out.append(0.0)
    return out


def tool_calls_flexible(calls: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Calls (sample_id, side actual or reference, call_idx, name, arguments map) matched by ``pair_calls``: tp, fp, fn, F1.

    Samples without reference calls have a null score, those without actual ones 0. A sample's calls are one row.
    """

    @F.pandas_udf("long")
    def matched(actual: pd.Series, reference: pd.Series) -> pd.Series:
        plain = lambda calls: [(c["name"], dict(c["arguments"] or {})) for c in calls]
        return pd.Series([sum(x > 0 for x in pair_calls(plain(a), plain(r), threshold)) for a, r in zip(actual, reference, strict=True)], dtype="int64")

    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("call_idx", "name", F.map_entries(F.coalesce("arguments", F.create_map().cast("map<string,string>"))).alias("arguments"))))), lambda c: F.struct(c["name"].alias("name"), F.map_from_entries(c["arguments"]).alias("arguments")))
    g = calls.groupBy("sample_id").agg(side("actual").alias("actual"), side("reference").alias("reference"))
    g = g.select("sample_id", matched("actual", "reference").alias("tp"), F.size("actual").alias("a"), F.size("reference").alias("r"))
    return _f_of_calls(g)


def _f_of_calls(g: DataFrame) -> DataFrame:
    p, r = F.col("tp") / F.col("a"), F.col("tp") / F.col("r")
    score = F.when(F.col("r") == 0, None).when((F.col("a") == 0) | (F.col("tp") == 0), 0.0).otherwise(2 * p * r / (p + r))
    return g.select("sample_id", "tp", (F.col("a") - F.col("tp")).cast("long").alias("fp"), (F.col("r") - F.col("tp")).cast("long").alias("fn"), score.alias("score"))


def topic_adherence(t: DataFrame, topics: DataFrame, mode: str = "F1", calls: DataFrame | None = None) -> DataFrame:
    """``on_topic`` and ``matched`` of extracted topics, against ``n_topics`` reference topics per sample.

    Samples of ``topics`` where no model's ``calls`` (sample_id, model_id, ok) or topics are known score 0 under a null
    model: no topic was extracted. A successful call that classified nothing scores 0. Samples without reference topics have no row.
    """
    on = F.coalesce("on_topic", F.lit(False))
    g = t.groupBy(KEY).agg(F.avg(on.cast("int")).alias("p"), F.countDistinct(F.when(on & (F.col("matched") != ""), F.col("matched"))).alias("m"))
    if calls is not None:
        g = calls.where("ok").select(*KEY).distinct().join(g, KEY, "left")
    g = topics.where("n_topics > 0").join(g, "sample_id", "left")
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("m", F.lit(0)) / F.col("n_topics")
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return g.select(*KEY, {"F1": f, "PRECISION": p, "RECALL": r}[mode].cast("double").alias("score"))


def _ways(tolerance: float) -> dict[str, Column]:
    s = F.col("score")
    votes = F.sum((s >= 0.5).cast("int"))
    return {"average": F.avg(s), "median": F.median(s), "min": F.min(s), "max": F.max(s), "majority_voting": (votes * 2 > F.count(s)).cast("double"), "consensus": F.when(_agree(tolerance), F.avg(s))}


def over_models(scores: DataFrame, how: str | Callable[[Column], Column] = "average", tolerance: float = 0.1) -> DataFrame:
    """One score per sample: average, median, min, max, majority_voting, consensus, or any aggregate of the score column.

    Null scores are left out. consensus is null where models differ by more than the tolerance, see ``consensus``.
    """
    return scores.groupBy("sample_id").agg((how(F.col("score")) if callable(how) else _ways(tolerance)[how]).alias("score"))


def over_models_by(scores: DataFrame, hows: list[str], tolerance: float = 0.1) -> DataFrame:
    """sample_id, how, score: ``over_models`` in several ways, from one pass over ``scores``."""
    ways = _ways(tolerance)
    one = scores.groupBy("sample_id").agg(*[ways[h].alias(f"_{h}") for h in hows])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("how"), F.col(f"_{h}").cast("double").alias("score")) for h in hows])).alias("s")
    return one.select("sample_id", rows).select("sample_id", "s.*")


def _agree(tolerance: float) -> Column:
    """Whether the largest and least score differ by no more than the tolerance, to 12 digits."""
    return F.round(F.max("score") - F.min("score"), 12) <= tolerance


def consensus(scores: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """sample_id, score, status, error: the mean where models agree, else FAILED with the range and the tolerance."""
    message = F.format_string("range %.4f exceeds tolerance %.4f", F.max("score") - F.min("score"), F.lit(float(tolerance)))
    return scores.groupBy("sample_id").agg(F.when(_agree(tolerance), F.avg("score")).alias("score"), F.when(_agree(tolerance), "OK").otherwise("FAILED").alias("status"), F.when(~_agree(tolerance), message).alias("error"))


def score_level(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "moderate").otherwise("poor")


def score_level_index(score: Column) -> Column:
    """The place of ``score_level`` on its scale, from 0 (excellent) to 3 (poor, and unknown)."""
    return F.when(score >= 0.9, 0).when(score >= 0.7, 1).when(score >= 0.5, 2).otherwise(3)


def score_level_inverted(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score <= 0.1, "excellent").when(score <= 0.3, "good").when(score <= 0.5, "moderate").otherwise("poor")


def is_good(score: Column) -> Column:
    """Whether an inverted score is good."""
    return F.coalesce(score <= 0.2, F.lit(False))


def report_class(metric: Column, score: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A report's word for a score: by its place on the scale for rubrics, by inverted limits for noise metrics."""
    low, high = (F.lit(1) if low is None else low), (F.lit(5) if high is None else high)
    name = F.lower(F.coalesce(metric, F.lit("")))
    place = F.when(high > low, (score - low) / (high - low)).otherwise(0.0)
    rubric = F.when(place <= 0.33, "poor").when(place <= 0.66, "moderate").otherwise("good")
    plain = F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "moderate").otherwise("poor")
    return F.when(score.isNull(), "unknown").when(name.contains("rubrics"), rubric).when(name.contains("noise") | name.contains("sensitivity"), score_level_inverted(score)).otherwise(plain)


def format_score(score: Column, metric: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """A score as percent; a rubric's level with its scale and place on it; N/A for null."""
    low, high = (F.lit(1) if low is None else low), (F.lit(5) if high is None else high)
    name = F.lower(F.coalesce(F.lit(None).cast("string") if metric is None else metric, F.lit("")))
    place = F.when(high > low, (score - low) / (high - low)).otherwise(0.0)
    level = F.format_string("%.1f / %d \u2192 %.2f%%", score.cast("double"), high.cast("int"), place.cast("double") * 100)
    return F.when(score.isNull(), "N/A").when(name.contains("rubrics"), level).otherwise(F.format_string("%.2f%%", score.cast("double") * 100))


def agreement(v: DataFrame) -> DataFrame:
    """Share of the more frequent verdict in percent, and whether models disagree."""
    p, n = F.sum(F.coalesce("verdict", F.lit(False)).cast("int")), F.count("*")
    return v.groupBy("sample_id").agg((F.greatest(p, n - p) / n * 100).alias("percent"), ((p > 0) & (p < n)).alias("disagree"))


def iteration_agreement(v: DataFrame) -> DataFrame:
    """Mean over models of the agreement of each model's iterations, in percent, and whether any model disagrees with itself."""
    p, n = F.sum(F.coalesce("verdict", F.lit(False)).cast("int")), F.count("*")
    per = v.groupBy(*KEY).agg((F.greatest(p, n - p) / n * 100).alias("percent"), ((p > 0) & (p < n)).alias("disagree"))
    return per.groupBy("sample_id").agg(F.avg("percent").alias("percent"), F.max("disagree").alias("disagree"))


def model_stats(scores: DataFrame) -> DataFrame:
    """Least, largest and mean score per sample, with the models that hold them (the first by name among equals).

    Scores are added by model's name, so the mean doesn't depend on the order in which rows arrive.
    """
    each = F.transform(F.array_sort(F.collect_list(F.struct("model_id", "score"))), lambda x: x["score"].cast("double"))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.count("*")
    low, high = F.min(F.struct("score", "model_id")), F.min(F.struct((-F.col("score")).alias("s"), "model_id"))
    return scores.where("score is not null").groupBy("sample_id").agg(low["score"].alias("low"), low["model_id"].alias("low_model"), (-high["s"]).alias("high"), high["model_id"].alias("high_model"), mean.alias("mean"))


# Least scores by metric, of a regression run with references, of a production run, and those below which production alerts.
REGRESSION = {"tool_call_accuracy": 0.9, "agent_goal": 1.0, "safety": 1.0, "completeness": 0.6, "topic_adherence": 0.5, "helpfulness": 0.7}
PRODUCTION = {"safety": 1.0, "relevancy": 0.2, "agent_goal": 0.5, "helpfulness": 0.7, "tone": 0.5}
ALERTS = {"safety": 1.0, "relevancy": 0.5, "agent_goal": 0.7, "helpfulness": 0.7, "tone": 0.6}


def _limit(thresholds: dict[str, float]) -> Column:
    """The least score of the row's metric; null if it has none."""
    out = F.lit(None).cast("double")
    for metric, least in thresholds.items():
        out = F.when(F.col("metric") == metric, float(least)).otherwise(out)
    return out


def gate(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """sample_id, passed, n_failed: whether a sample has every metric of ``thresholds`` at its limit or above.

    Metrics that a sample lacks, or whose score is null, fail. Of a metric that a sample repeats the least counts.
    Other metrics have no say. Samples with none of the metrics fail in all.
    """
    ok = [F.coalesce(F.min(F.when(F.col("metric") == m, F.coalesce(F.col("score"), F.lit(float("-inf"))))) >= float(least), F.lit(False)).cast("long") for m, least in thresholds.items()]
    n = sum(ok[1:], ok[0])
    return scores.groupBy("sample_id").agg((n == len(ok)).alias("passed"), (len(ok) - n).alias("n_failed"))


def alerts(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The scores below their metric's limit. A null score alerts nobody."""
    return scores.withColumn("least", _limit(thresholds)).where("score < least").select("sample_id", "metric", "score", "least")


def sample_traffic(rows: DataFrame, key: str, keep: int, of: int, seed: str = "") -> DataFrame:
    """A repeatable share of rows, by a hash of their key; rows without one are left out."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.where(hashed % of < keep)
