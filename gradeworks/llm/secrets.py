"""Secrets in texts, and weak parts of credentials that count only beside their counterparts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import boundary

# The patterns of the contract. A run of 24 hex digits or an access id of 20 characters is
# found with the lower bound inside of the pattern: shorter runs fail wherever they start.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
WEAK = {
    "weak_id": r"""(?i:user(?:name)?|login|client_?id|account(?:_?id)?|access_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._-]{3,}""",
    "weak_secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"https?://[A-Za-z0-9.-]{4,}(?::[0-9]{1,5})?",
}
KINDS = [*BASE, *WEAK]
#: Parts belong together if they start within so many code points; a part has 8 at least, so no more of
#: them than NEIGHBOURS start in a scope on either side.
SCOPE, LEAST = 240, 8
NEIGHBOURS = (SCOPE // LEAST + 1) * len(KINDS)


#: Spans in a chunk: sums and searches go by chunks first, so that texts of many matches take little more than linear time.
CHUNK = 64
SPANS = "array<struct<start:int,rank:int,end:int>>"


def _chunks(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _chunk(values: str, k: Column) -> Column:
    return F.slice(values, k * CHUNK + 1, F.lit(CHUNK))


def _spans(df: DataFrame, rank: int) -> DataFrame:
    """Add ``s_all``: start and end (code points) of the matches ``s_found`` between the gaps ``s_gaps``, with the rank of their kind."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sizes = F.zip_with(F.slice("s_gaps", F.lit(1), F.size("s_found")), "s_found", lambda g, f: F.struct(F.length(g).alias("gap"), F.length(f).alias("own")))
    df = boundary(df, s_size=F.when(F.size("s_found") > 0, sizes).otherwise(F.array().cast("array<struct<gap:int,own:int>>")))
    df = boundary(df, s_sums=F.transform(_chunks(F.size("s_size")), lambda k: total(F.transform(_chunk("s_size", k), lambda x: x["gap"] + x["own"]))))
    df = boundary(df, s_base=F.transform("s_sums", lambda x, k: total(F.slice("s_sums", F.lit(1), k))))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["own"]
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))).alias("out"))

    within = lambda at, k: F.aggregate(_chunk("s_size", k), F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step)["out"]
    return boundary(df, s_all=F.flatten(F.transform("s_base", within))).drop("s_size", "s_sums", "s_base")


def _with(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    df = boundary(df, s_found=F.regexp_extract_all("s_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("s_gaps", F.when(F.size("s_found") > 0, F.split("s_text", pattern, -1)))
    df = _spans(df, KINDS.index(kind))
    if kind == "assign":
        keep = F.filter("s_all", lambda x, i: F.length(F.regexp_extract(F.get("s_found", i), ASSIGN, 2)) >= 6)
    elif kind == "weak_secret":
        strong = lambda t: t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
        keep = F.filter("s_all", lambda x, i: strong(F.get("s_found", i)))
    else:
        keep = F.col("s_all")
    return df.select("doc_id", "s_text", *[c for c in df.columns if c.startswith("k_")], keep.alias(f"k_{kind}"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(name, x["rank"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points).

    Weak parts (account names, random-looking tokens, addresses) are interval-joined with the other parts of
    the same text whose start lies within SCOPE: an identifier counts beside a secret, a secret beside an
    identifier, an address beside both. As matches of one kind don't overlap, a part's scope is a slice of
    bounded length of the sorted parts, so the join is linear and no row leaves its task.

    Null texts count as empty: no spans. Rows are judged by their text alone; null ids are carried
    through. Empty table: no rows.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("s_text"))
    for kind, pattern in (BASE | WEAK).items():
        df = _with(df, kind, pattern)
    base = F.sort_array(F.concat(*[F.col(f"k_{k}") for k in BASE]))
    df = boundary(df.drop("s_text"), base=base)
    # a chunk of the sorted base spans is searched only if it reaches the weak part
    reach = lambda k: F.struct(F.get("base", k * CHUNK)["start"].alias("start"), F.array_max(F.transform(_chunk("base", k), lambda b: b["end"])).alias("end"), k.alias("k"))
    df = boundary(df, reach=F.transform(_chunks(F.size("base")), reach))
    meets = lambda b, w: (b["start"] < w["end"]) & (w["start"] < b["end"])
    clear = lambda w: ~F.exists("reach", lambda c: meets(c, w) & F.exists(_chunk("base", c["k"]), lambda b: meets(b, w)))
    weak = F.concat(*[F.col(f"k_{k}") for k in WEAK])
    df = boundary(df, weak=F.when(F.size(weak) > 0, F.filter(weak, clear)).otherwise(weak))
    df = boundary(df, parts=F.when(F.size("weak") > 0, F.sort_array(F.concat("base", "weak"))).otherwise(F.col("base")))
    rank = {k: i for i, k in enumerate(KINDS)}

    def near(x: Column, i: Column, kinds: tuple[str, ...]) -> Column:
        around = F.slice("parts", F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        return F.exists(around, lambda y: y["rank"].isin([rank[k] for k in kinds]) & (F.abs(y["start"] - x["start"]) <= SCOPE) & (y != x))

    ids, keys = ("access", "weak_id"), ("assign", "hex", "weak_secret")

    def linked(x: Column, i: Column) -> Column:
        r = x["rank"]
        return (r < len(BASE)) | ((r == rank["weak_id"]) & near(x, i, keys)) | ((r == rank["weak_secret"]) & near(x, i, ids)) | ((r == rank["endpoint"]) & near(x, i, ids) & near(x, i, keys))

    every = F.when(F.size("weak") > 0, F.filter("parts", linked)).otherwise(F.col("base"))
    return df.select("doc_id", *[F.size(f"k_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))
