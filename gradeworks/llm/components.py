"""Connected components of a table of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``links`` (a, b: long): comp is the smallest id reachable.

    Each round every group hooks onto the smallest one within two links, which makes a star one group at once, and
    chains are cut to a quarter until they are flat. A group's edges meet only in sums, never in one task. Self links
    keep their end as a group of its own; no links give no rows.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while label is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        up = cut(both.join(low.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("low").alias("up")))
        while True:
            two = _composed(up, up)
            jumped = cut(_composed(two, two).withColumn("moved", F.col("up") != F.col("was")))
            up = jumped.select("a", "up")
            if jumped.where("moved").isEmpty():
                break
        label = _composed(label, up).select("a", "up") if label is not None else up
        left, right = up.select("a", F.col("up").alias("x")), up.select(F.col("a").alias("b"), F.col("up").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label.select(F.col("a").alias("id"), F.col("up").alias("comp"))


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(a, up, was) of two maps (a, up), one after the other; was is what the first alone gives. What the second lacks stays."""
    then = then.select(F.col("a").alias("was"), F.col("up").alias("next"))
    return first.select("a", F.col("up").alias("was")).join(then, "was", "left").select("a", F.coalesce("next", "was").alias("up"), "was")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (id, comp: the smallest id of its group) with the groups made one that ``links`` (a, b) join. Only groups with a new link are searched."""
    x, y = (comp.select(F.col("id").alias(k), F.col("comp").alias(f"of_{k}")) for k in "ab")
    new = links.join(x, "a").join(y, "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    to = components(new).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return cut(comp.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
