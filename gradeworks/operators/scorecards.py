"""Scorecards of a data set: means and quantiles for every grouping of metric, model and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a sketch over [0, 1]; a quantile is off by one bucket's width at most.
BUCKETS = 1000
QUANTILES = (0.05, 0.5, 0.95)


def sketch(scores: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keys, bucket, n, total: how many scores of each bucket, and their sum. Scores outside [0, 1] go to the outer buckets, null ones are left out."""
    place = F.least(F.greatest(F.floor(F.col("score") * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    return scores.where("score is not null").groupBy(*keys, place.alias("bucket")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch of several for the same keys: it is what the scores together would give."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def scorecard(sketches: DataFrame, sets: list[list[str]], keys: list[str], quantiles: tuple[float, ...] = QUANTILES, buckets: int = BUCKETS) -> DataFrame:
    """keys (null where a set leaves one out), grouping (the set's columns), n, mean and q5, q50 ... for each of the grouping ``sets``.

    The scores are read once, into counts by all keys and bucket; the sets only add those up. A quantile is the upper
    end of the bucket that reaches its share of the rows.
    """
    # a row per set and bucket of all keys: as bounded as the sketch itself
    each = [F.struct(F.lit(",".join(s)).alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast("string")).alias(k) for k in keys]) for s in sets]
    rows = sketches.select(F.explode(F.array(*each)).alias("g"), "bucket", "n", "total").select("g.*", "bucket", "n", "total")
    by = ["grouping", *keys]
    one = rows.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy(*by)
    cum = one.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col("bucket") + 1)) / buckets
    return cum.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), *[at(q).alias(f"q{round(q * 100)}") for q in quantiles])


def exact(scores: DataFrame, sets: list[list[str]], keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``scorecard`` with exact quantiles (the smallest score that reaches the share): every set reads the scores."""
    at: list[Column] = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY score)").alias(f"q{round(q * 100)}") for q in quantiles]
    out = None
    for s in sets:
        one = scores.where("score is not null").groupBy(*s).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), *at)
        columns = [F.lit(",".join(s)).alias("grouping"), *[F.col(k) if k in s else F.lit(None).cast("string").alias(k) for k in keys]]
        one = one.select(*columns, "n", "mean", *[f"q{round(q * 100)}" for q in quantiles])
        out = one if out is None else out.unionByName(one)
    return out
