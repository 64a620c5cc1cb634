"""N-grams and normalized words of odd texts against plain Python, and that no lambda runs over each of a text's words or characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.functions import text as tx

ODD = ["", "a", "abc", "abcd", "Ab\nЁж 日本 x\U0001f600y", "one two three four", "\x01 \n a\x02 \t b \x1fA  ΑΣ ΑΣ\x03", " ", "\n", None, "é" * 50_000 + " x y"]


def test_ngrams_are_those_of_plain_python_and_no_lambda_makes_them(spark):
    t = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, text string").repartition(2)
    words = F.split("text", " ")
    got = t.select("i", "text", tx.word_ngrams(words, 2).alias("w"), tx.word_ngrams(words, 2, "\x1e").alias("wj"), tx.char_ngrams(F.col("text"), 4).alias("c"), tx.char_ngrams(F.col("text"), 4, "\x1e").alias("cj"))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        w, low = (r.text or "").split(" ") if r.text is not None else [], (r.text or "").lower()
        assert r.w == [f"{a} {b}" for a, b in zip(w, w[1:])] and r.c == [low[k : k + 4] for k in range(len(low) - 3)], r.i
        assert (r.wj.n, r.wj.joined) == (len(r.w), "\x1e".join(r.w)) and (r.cj.n, r.cj.joined) == (len(r.c), "\x1e".join(r.c)), r.i


def test_words_normalized_at_once_are_those_normalized_one_by_one(spark):
    t = spark.createDataFrame([(s,) for s in ODD], "text string")
    one = F.transform(F.split("text", " "), lambda x: F.lower(tx.trimmed(x)))
    fast = tx.normalized_words(F.col("text"))
    rows = t.select(one.alias("one"), fast.alias("fast"), tx.normalized_entities(F.split("text", " ")).alias("names"), tx.distinct_entities(fast).alias("quick")).collect()
    assert all(r.one == r.fast and r.names == r.quick for r in rows)
    assert "lambda" not in t.select(tx.distinct_entities(fast))._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_those_of_the_expressions_in_spark(spark):
    t = spark.createDataFrame([(s,) for s in [*ODD, "Straße, ÉTÉ ёж! x_y--z 12\x0b3 \x85a b"]], "text string")
    plain = F.filter(F.split(tx.parted(F.col("text")), r"\s+"), lambda x: x != "")
    fast = t.select(plain.alias("plain"), tx.tokenize(F.col("text")).alias("fast"))
    assert all(r.plain == r.fast for r in fast.collect())
    assert "regexp_replace" not in t.select(tx.tokenize(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
