"""Quality rules as weak supervision, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import boundary, cut, packed, words
from gradeworks.llm.label_model import fit_kinds, good_chance, patterns

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_marks")
#: Chances at first that a rule votes against a good text, against a bad text of its own kind, and against one of another kind.
START = {"prior": 0.8, "good": 0.003, "own": 0.95, "other": 0.1}
RULES = ("v_repeats", "v_symbols", "v_lines", "v_size", "v_case", "v_marks")


def _count(text: str, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def measured(rows: DataFrame) -> DataFrame:
    """Add MEASURES of the column ``text`` as a struct ``m``.

    Words in 3-word windows found twice: the windows' 64-bit hashes, each with its position in the low
    bits that the text's length needs, are sorted; equal neighbours are repeats. No rows are exploded,
    so a text costs n log n wherever it lies, and nothing shuffles.
    """
    one = boundary(rows, q_text=F.coalesce(F.col("text"), F.lit("")), q_words=words(F.col("text")))
    two = boundary(one, q_hash=F.transform("q_words", lambda w: F.xxhash64(w)), q_n=F.size("q_words"))
    bits = F.expr("int(ceil(log2(q_n + 1)))")
    window = lambda i: F.xxhash64(F.get("q_hash", i), F.get("q_hash", i + 1), F.get("q_hash", i + 2))
    keyed = F.transform(F.sequence(F.lit(0), F.col("q_n") - 3), lambda i: F.call_function("shiftleft", window(i), F.col("q_bits")).bitwiseOR(i.cast("long")))
    three = boundary(two.withColumn("q_bits", bits), q_keys=F.when(F.col("q_n") >= 3, F.sort_array(keyed)).otherwise(F.array().cast("array<bigint>")))
    top = lambda x: F.call_function("shiftrightunsigned", x, F.col("q_bits"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q_bits")) - 1
    at = F.transform(F.filter("q_keys", lambda x, i: F.coalesce(top(x) == top(F.get("q_keys", F.greatest(i - 1, F.lit(0)))), F.lit(False)) & (i > 0) | F.coalesce(top(x) == top(F.get("q_keys", i + 1)), F.lit(False))), lambda x: x.bitwiseAND(low))
    four = boundary(three, q_at=F.sort_array(at), q_lines=F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    covered = F.aggregate("q_at", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("p")), lambda s, x: F.struct((s["n"] + F.least(x - s["p"], F.lit(3).cast("bigint"))).alias("n"), x.alias("p")))["n"]
    m = F.struct(
        F.col("q_n").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        _count("q_text", "#*$%&|<>").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _count("q_text", r"\p{Lu}").alias("n_upper"),
        _count("q_text", r"\p{Ll}").alias("n_lower"),
        _count("q_text", "!?").alias("n_marks"),
        F.size("q_lines").cast("long").alias("n_lines"),
    )
    return boundary(four, m=m).drop("q_text", "q_words", "q_hash", "q_n", "q_bits", "q_keys", "q_at", "q_lines")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """What each rule says of the measures ``m``: 1 keep, -1 drop, 0 no opinion (also wherever there is no word)."""
    m = F.col("m")
    n, letters = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_upper"] + m["n_lower"], F.lit(1))
    return {
        "v_repeats": _vote(m["n_repeat_words"] * 100 > n * 40, m["n_repeat_words"] * 100 < n * 15),
        "v_symbols": _vote(m["n_symbols"] * 100 > n * 25, m["n_symbols"] * 100 < n * 5),
        "v_lines": _vote((m["n_dup_lines"] * 100 > m["n_lines"] * 80) & (m["n_repeat_words"] * 100 > n * 30), m["n_dup_lines"] * 100 <= m["n_lines"] * 10),
        "v_size": _vote((m["word_chars"] > n * 14) | (m["word_chars"] * 2 < n * 5), m["word_chars"].between(n * 3, n * 9)),
        "v_case": _vote((m["n_upper"] * 100 > letters * 50) & (m["n_words"] > 0), m["n_upper"] * 100 < letters * 20),
        "v_marks": _vote(m["n_marks"] * 100 > n * 40, m["n_marks"] * 100 < n * 10),
    }


def base_failed() -> Column:
    m = F.col("m")
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def learned(scored: DataFrame) -> dict:
    """The label model of ``scored`` (``m`` and RULES), from all its rows but those that failed already."""
    return fit_kinds(cut(patterns(scored.where(~base_failed()), RULES)), RULES, **START)


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, measures, base_failed, posterior, kept.

    kept: not base_failed and a posterior of good quality of at least ``least``. Null texts count as empty
    texts: no words, base_failed. Rows are judged by their text alone, so repeated rows get the same
    verdict and null ids are carried through. Empty table: no rows.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "m")
    rows = cut(rows.select("doc_id", "m", *[v.alias(k) for k, v in votes().items()]))
    p = good_chance(RULES, learned(rows))
    return rows.select("doc_id", *[F.col("m")[k].alias(k) for k in MEASURES[:5]], base_failed().alias("base_failed"), F.round(p, 6).alias("posterior"), (~base_failed() & (p >= least)).alias("kept"))


def stage(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    Measures are taken once: rows that the base rules leave are written with their votes, and the label
    model is fitted on and applied to that table. Null and empty texts fail the base rules; rows are judged
    by their text alone; repeated rows share their verdict; an empty table gives no rows.
    """
    left = measured(packed(docs)).where(~base_failed())
    rows = cut(left.select("row", *[v.alias(k) for k, v in votes().items()]))
    model = fit_kinds(cut(patterns(rows, RULES)), RULES, **START)
    return rows.where(good_chance(RULES, model) >= least).select("row.*")
