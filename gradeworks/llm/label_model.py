"""Label models: rules vote 1, -1 or abstain (0); expectation-maximisation finds what a vote is worth."""

from __future__ import annotations

from collections.abc import Sequence

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import boundary

#: Votes of a rule that does not abstain, in the order of the tables below.
VOTES = (1, -1)
#: Where the iteration starts unless told otherwise: the chances of a rule's votes in the class that 1 speaks for, and in the other.
START = ((0.9, 0.1), (0.1, 0.9))


def patterns(votes: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rows per combination of votes: at most 3^rules rows however many rows vote."""
    return votes.groupBy(*rules).agg(F.count("*").alias("n"))


def posterior(rules: Sequence[str], model: dict) -> Column:
    """Probability of the class that a vote of 1 speaks for; a rule that abstains says nothing."""
    score = F.lit(model["prior"])
    for r in rules:
        p, q = model["rules"][r]
        score = score + F.when(F.col(r) > 0, F.lit(p)).when(F.col(r) < 0, F.lit(q)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def fit(counts: DataFrame, rules: Sequence[str], prior: float, rounds: int = 12, strength: float = 2.0, start: tuple = START) -> dict:
    """Log-odds of the classes and of each rule's votes, by ``rounds`` of expectation-maximisation over ``counts``.

    Each round is one aggregation of the vote table and brings a fixed number of sums to the driver.
    ``strength`` pseudo-rows at the starting chances keep votes that nobody cast finite. No rows: the start.
    """
    good, bad = (dict.fromkeys(rules, x) for x in start)
    for _ in range(rounds + 1):
        model = {"prior": log(prior / (1 - prior)), "rules": {r: tuple(log(a / b) for a, b in zip(good[r], bad[r], strict=True)) for r in rules}}
        p = posterior(rules, model)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * p).alias("p")]
        for r in rules:
            for i, v in enumerate(VOTES):
                hit = F.when(F.col(r) == v, F.col("n"))
                sums += [F.sum(hit * p).alias(f"{r}_{i}_g"), F.sum(hit * (1 - p)).alias(f"{r}_{i}_b")]
        s = counts.agg(*sums).first()
        if not s["n"]:
            return model
        prior = min(max((s["p"] + strength / 2) / (s["n"] + strength), 1e-4), 1 - 1e-4)
        for side, name, first in ((good, "g", start[0]), (bad, "b", start[1])):
            for r in rules:
                found = [(s[f"{r}_{i}_{name}"] or 0) + strength * first[i] for i in range(2)]
                side[r] = tuple(x / sum(found) for x in found)
    return model


def _score(rules: Sequence[str], model: dict, kind: int, beside: int | None = None) -> Column:
    """Log weight of a class for a row's votes, less that of the class ``beside``."""
    value = lambda f: f(kind) - (0.0 if beside is None else f(beside))
    out = F.lit(value(lambda k: log(model["share"][k])))
    for i, r in enumerate(rules):
        against, keep = value(lambda k: log(model["against"][k][i])), value(lambda k: log(1 - model["against"][k][i]))  # noqa: B023
        out = out + F.when(F.col(r) < 0, against).when(F.col(r) > 0, keep).otherwise(0.0)
    return out


def good_chance(rules: Sequence[str], model: dict) -> Column:
    """Probability of the good class under a model of kinds."""
    total = F.lit(1.0)
    for k in range(1, len(rules) + 1):
        total = total + F.exp(_score(rules, model, k, 0))
    return 1 / total


def fit_kinds(counts: DataFrame, rules: Sequence[str], prior: float, good: float, own: float, other: float, rounds: int = 12, strength: float = 2.0) -> dict:
    """Shares of a good class and of one bad kind per rule, and the chance that each rule votes against each.

    Bad rows come in kinds that break different rules, so one bad class would put the largest kind alone in
    it and hand the others to the good. Each kind starts with the chance ``own`` that its rule votes against
    and ``other`` that another does; the good class with ``good``. Each round is one aggregation of ``counts`` (n and
    the votes) that brings a row per class to the driver. ``strength`` pseudo-rows hold the start. No rows: the start.
    """
    many = len(rules)
    first = [[good] * many] + [[own if i == k else other for i in range(many)] for k in range(many)]
    share0 = [prior] + [(1 - prior) / many] * many
    model = {"share": share0, "against": first}
    for _ in range(rounds):
        scored = boundary(counts, s=F.array(*[_score(rules, model, k) for k in range(many + 1)]))
        top = boundary(scored, top=F.array_max("s"))
        raised = boundary(top, e=F.transform("s", lambda x: F.exp(x - F.col("top"))))
        rows = boundary(raised, all=F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).select("n", "all", *rules, F.posexplode("e").alias("kind", "p"))
        weight = F.col("n") * F.col("p") / F.col("all")
        sums = [F.sum(weight).alias("w")]
        for r in rules:
            sums += [F.sum(F.when(F.col(r) < 0, weight).otherwise(0.0)).alias(f"{r}_a"), F.sum(F.when(F.col(r) != 0, weight).otherwise(0.0)).alias(f"{r}_v")]
        got = {x["kind"]: x for x in rows.groupBy("kind").agg(*sums).collect()}
        if not got:
            return model
        total = sum(x["w"] for x in got.values())
        model = {
            "share": [(got[k]["w"] + strength * share0[k]) / (total + strength) for k in range(many + 1)],
            "against": [[(got[k][f"{r}_a"] + strength * first[k][i]) / (got[k][f"{r}_v"] + strength) for i, r in enumerate(rules)] for k in range(many + 1)],
        }
    return model
