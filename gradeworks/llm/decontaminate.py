"""Benchmark passages in documents: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

DataFrame functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import boundary, cut, key, packed, words

#: Fingerprints have 64 bits in BLOCKS blocks; each item is indexed under every value within NEAR bits of each of its blocks.
BLOCKS, NEAR = 4, 3
#: Two fingerprints within this distance differ by at most NEAR bits in one block, so the index finds them all.
RADIUS = BLOCKS * (NEAR + 1) - 1
SHINGLE = 5
#: A benchmark of at most so many shingles is broadcast; a larger one is joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashes(text: Column) -> Column:
    return F.transform(words(_folded(text)), lambda w: F.xxhash64(w))


def _windows(h: str, n: str, size: int) -> Column:
    """Hashes of the windows of ``size`` words in order."""
    at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])
    return F.when(F.col(n) >= size, F.transform(F.sequence(F.lit(0), F.col(n) - size), at)).otherwise(F.array().cast("array<bigint>"))


def _shingles(h: str, n: str) -> Column:
    """Hashes of the 5-word windows in order; a shorter text is one shingle."""
    out = _windows(h, n, SHINGLE)
    for size in range(1, SHINGLE):
        out = F.when(F.col(n) == size, _windows(h, n, size)).otherwise(out)
    return out


def simhash(h: Column) -> Column:
    """64-bit SimHash of word hashes: each bit is the majority of the words' bits."""
    bit = lambda b: F.aggregate(h, F.lit(0), lambda s, x: s + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1).cast("bigint")).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(F.when(bit(b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))))


def _blocks(f: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(f, 64 // BLOCKS * i).bitwiseAND((1 << 64 // BLOCKS) - 1).cast("int").alias("v")) for i in range(BLOCKS)])


def _flips() -> list[int]:
    bits = range(64 // BLOCKS)
    return [sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(bits, k)]


def _placed(hits: DataFrame, row: list[str], percent: int) -> DataFrame:
    """Every window (row, start, n, words w) of n words with enough ``hits`` (places pos of shingles that items of n words have).

    A window with c shingles has k of the sorted places p if p[i + k - 1] - c < start <= p[i] for some i;
    a start is taken from its first i alone.
    """
    c = hits.withColumn("c", F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))).withColumn("lo", F.greatest(F.col("pos") - F.col("c") + 1, F.lit(0)))
    near = c.select(*row, "n", "m", "c", F.struct("pos", "lo", F.slice("h", F.col("lo") + 1, F.col("pos") - F.col("lo") + F.col("n")).alias("near")).alias("p"))
    p = boundary(near.groupBy(*row, "n", "m", "c").agg(F.collect_set("p").alias("p")), s=F.array_sort("p")).drop("p")
    need = F.greatest(F.ceil(F.col("c") * (2 * percent) / (100 + percent)).cast("int"), F.lit(1))
    p = p.withColumn("need", need).where(F.size("s") >= F.col("need"))

    def starts(i: Column) -> Column:
        last, before = F.get("s", i + F.col("need") - 1)["pos"] - F.col("c") + 1, F.when(i > 0, F.get("s", i - 1)["pos"] + 1)
        return F.struct(F.get("s", i).alias("p"), F.greatest(last, before, F.lit(0)).alias("a"), F.least(F.get("s", i)["pos"], F.col("m") - F.col("n")).alias("b"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - F.col("need")), starts), lambda x: x["a"] <= x["b"])
    at = p.select(*row, "n", F.explode(runs).alias("x")).select(*row, "n", "x.p.lo", "x.p.near", F.explode(F.sequence("x.a", "x.b")).alias("start"))
    return at.select(*row, "start", "n", F.slice("near", F.col("start") - F.col("lo") + 1, F.col("n")).alias("w"))


def passages(docs: DataFrame, items: DataFrame, row: list[str], percent: int = 80) -> DataFrame:
    """Windows of ``docs`` that match an item: the columns ``row`` of docs, item_id, start (word), similarity.

    Windows have the length of an item in words. Two windows of c shingles each reach ``percent`` only with
    2 c percent / (100 + percent) shingles in common, so every window with that many places whose shingle
    some item of its length has is looked up, wherever it starts. Its SimHash is looked up in the
    multi-index of the items' fingerprints, which returns all within RADIUS; of those, windows with
    weighted-shingle similarity (sum of smaller over sum of larger counts of 5-word shingles) of at least
    ``percent`` / 100 stay. Words are compared with A-Z lower-cased. Items without words match nothing.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    i1 = boundary(items, h=_hashes(F.col("text"))).drop("text")
    i2 = boundary(i1, n=F.size("h")).where("n > 0")
    items = cut(boundary(boundary(i2, sh=_shingles("h", "n")), f=simhash(F.col("h"))).select("item_id", "n", "sh", "f"))
    anchors = cut(items.select("n", F.explode("sh").alias("s")).groupBy("s").agg(F.collect_set("n").alias("lengths")))
    index = items.select("item_id", "n", "f", F.inline(_blocks("f"))).select("item_id", "n", F.col("f").alias("item_f"), "b", F.explode(F.array(*[F.col("v").bitwiseXOR(F.lit(x)) for x in _flips()])).alias("v"))
    many = anchors.count()
    d1 = boundary(docs, h=_hashes(F.col("text")))
    d2 = boundary(d1, m=F.size("h")).select(*row, "h", "m")
    hits = None
    for size in [SHINGLE, *sorted(r.n for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect())]:
        at = boundary(d2, sh=_windows("h", "m", size)).select(*row, "h", "m", F.posexplode("sh").alias("pos", "s"))
        hit = at.join(F.broadcast(anchors) if many <= BROADCAST_SHINGLES else anchors, "s")
        hits = hit if hits is None else hits.union(hit)
    windows = _placed(hits.select(*row, "h", "m", "pos", F.explode("lengths").alias("n")).where("n <= m"), row, percent)
    w1 = boundary(boundary(windows, f=simhash(F.col("w"))), w_sh=_shingles("w", "n")).select(*row, "start", "n", "f", "w_sh")
    probe = w1.select("*", F.inline(_blocks("f")))
    pairs = probe.join(index.hint("merge"), ["n", "b", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))) <= RADIUS)
    near = pairs.groupBy(*row, "start", "item_id").agg(F.first("w_sh").alias("x")).join(items.select("item_id", F.col("sh").alias("y")), "item_id")
    count = lambda c, k: F.size(F.filter(c, lambda z: z == k))
    both = F.aggregate(F.array_distinct("x"), F.lit(0), lambda s, k: s + F.least(count("x", k), count("y", k)))
    scored = boundary(near, both=both).withColumn("total", F.size("x") + F.size("y") - F.col("both"))
    return scored.where(F.col("both") * 100 >= F.col("total") * percent).select(*row, "item_id", "start", F.round(F.col("both") / F.col("total"), 6).alias("similarity"))


def contamination(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (sorted), similarity (best, 0 without a match).

    Null, empty and wordless texts match nothing, as does any document for an empty benchmark. Rows that
    repeat a text get the same result; null doc_ids are carried through. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("k", key(F.col("text")))
    found = cut(passages(docs, items, ["k"], percent).groupBy("k").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity")))
    out = docs.select("doc_id", "k").join(found, "k", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def stage(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns.

    Null, empty and wordless texts stay, as do all rows if the benchmark is empty; repeated rows share their
    fate; an empty table gives no rows.
    """
    p = packed(docs).withColumn("k", key(F.col("text")))
    found = cut(passages(p, items, ["k"], percent).select("k").distinct())
    return p.join(found, "k", "left_anti").select("row.*")
