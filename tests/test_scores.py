"""Literal cases with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gradeworks.functions import text as tx
from gradeworks.operators import overlap, similarity, verdicts


def score(spark, f, a, b, name, **options):
    rows = f(spark.createDataFrame([(1, a, b)], "sample_id long, response string, reference string"), **options).collect()
    return rows[0][name]


@pytest.mark.parametrize(
    ("a", "b", "options", "want"),
    [
        ("The quick brown fox jumps over the dog", "The quick brown fox jumps over the lazy dog", {}, 0.784663),
        ("alpha beta gamma delta", "one two three four five six seven", {"smoothing": False}, 0.0),
        ("Hello world", "Hello world", {}, 0.57735),
        ("Hello world", "Hello world", {"smoothing": False}, 1.0),
        ("cat", "dog", {}, 0.5),
        ("", "dog", {}, None),
        ("!!", "dog", {}, 0.0),
    ],
)
def test_bleu(spark, a, b, options, want):
    got = score(spark, overlap.bleu, a, b, "bleu", **options)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_rouge_and_chrf(spark):
    nine = "The quick brown fox jumps over the lazy dog"
    assert score(spark, overlap.rouge_n, "The quick fox jumps", nine, "rouge") == pytest.approx(0.615385, abs=1e-6)
    assert score(spark, overlap.rouge_n, "The quick fox jumps", nine, "rouge", mode="RECALL") == pytest.approx(0.444444, abs=1e-6)
    assert score(spark, overlap.rouge_n, "The fox quick brown", "The quick brown fox", "rouge", n=2) == pytest.approx(0.333333, abs=1e-6)
    assert score(spark, overlap.rouge_n, "cat", "dog", "rouge", n=2) == 1.0
    assert score(spark, overlap.chrf, "colour behaviour favour", "color behavior favor", "chrf") == pytest.approx(0.632751, abs=1e-6)
    assert score(spark, overlap.chrf, "ab", "cd", "chrf") == pytest.approx(0.666667, abs=1e-6)
    assert score(spark, overlap.chrf, "fox brown quick the", "the quick brown fox", "chrf", word_order=2) == pytest.approx(0.56504, abs=1e-5)


def test_string_similarities(spark):
    df = spark.createDataFrame([("The quick brown fox", "The very quick and brown fox runs"), ("hello", "hello world"), ("prefix_abc", "prefix_xyz"), ("", "x")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(similarity.rouge_l(a, b).alias("l"), similarity.hamming_similarity(a, b).alias("h"), similarity.jaro_similarity(a, b).alias("j"), similarity.jaro_winkler_similarity(a, b).alias("w")).collect()
    assert rows[0].l == pytest.approx(0.727273, abs=1e-6)
    assert rows[1].h == pytest.approx(1 - 5 / 11)  # the pad of the sixth place equals the space there
    assert rows[2].j == pytest.approx(0.8) and rows[2].w == pytest.approx(0.88) and rows[3].l is None and rows[3].j is None
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_aggregators(spark):
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (2, "a", 0.5)], "sample_id long, model_id string, score double")
    got = {h: dict(verdicts.over_models(s, h, 0.05).collect()) for h in ("majority_voting", "consensus", "median")}
    assert got["majority_voting"] == {1: 0.0, 2: 1.0} and got["consensus"] == {1: None, 2: 0.5} and got["median"][1] == pytest.approx(0.45)


def test_cosine_and_reasons(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], "HTTP 429"), ([1.0, 1.0], [1.0, 1.0], None), ([1.0], [1.0, 2.0], "x" * 60)], "a array<float>, b array<float>, e string")
    rows = df.select(tx.cosine(F.col("a"), F.col("b")).alias("c"), tx.short_reason(F.col("e")).alias("r")).collect()
    assert [r.c for r in rows] == [0.0, pytest.approx(1.0), None]
    assert [r.r for r in rows] == ["rate limited", "unknown error", "x" * 47 + "..."]
