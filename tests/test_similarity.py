"""String similarities against plain versions, and their time on whole documents."""

import random
import time

from pyspark.sql import functions as F

from gradeworks.operators import similarity


def plain_matches(s, t, reach):
    free, left = [True] * len(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if free[j] and t[j] == c:
                free[j] = False
                left.append(c)
                break
    return "".join(left), "".join(c for c, f in zip(t, free, strict=True) if not f)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_against_plain_versions():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(r.choices("abcé🙂", k=r.randrange(0, 30))) for _ in range(2))
        reach = r.randrange(0, 12)
        assert similarity._matches(a, b, reach) == plain_matches(a, b, reach)
        d = plain_distance(a, b)
        assert similarity.levenshtein(a, b) == d
        for most in (d - 1, d, d + 3):
            assert similarity.levenshtein(a, b, most) == (d if d <= most else None)


def test_columns(spark):
    rows = [("hello", "hello world"), ("Kitten", "sitting"), ("", "x"), (None, "x"), ("same", "SAME"), ("é🙂x", "e🙂"), ("a", "bbbb")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", similarity.hamming_similarity(a, b).alias("h"), similarity.levenshtein_of_texts(a, b).alias("l"), similarity.levenshtein_similarity(a, b).alias("k"), similarity.levenshtein_of_texts(a, b, least=0.5).alias("m")).collect()
    for x, (p, q) in zip(got, rows, strict=True):
        if not p:
            assert x.h is None and x.l is None
            continue
        n = max(len(p), len(q))
        differ = sum(u != v for u, v in zip(p.lower().ljust(n), q.lower().ljust(n), strict=True))
        assert abs(x.h - (1 - differ / n)) < 1e-12 and abs(x.l - x.k) < 1e-12
        assert x.m == (x.l if x.l >= 0.5 else None)


def test_whole_documents_take_no_quadratic_time():
    r = random.Random(1)
    a = "".join(r.choices("abcdefghij ", k=100_000))
    b = "".join(c if r.random() < 0.9 else r.choice("xyz") for c in a)
    took = []
    for n in (25_000, 100_000):
        began = time.process_time()
        similarity.jaro(a[:n], b[:n])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2  # 16 times, were it quadratic
    assert 8_000 < similarity.levenshtein(a, b) < 11_000
    assert similarity.levenshtein(a, a[::-1], 1000) is None
