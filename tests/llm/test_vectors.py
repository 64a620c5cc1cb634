import hashlib
import math
import random

import numpy as np

from gradeworks.llm import codebooks, vectors, whitening
from gradeworks.llm import queries as Q

COLUMNS = "vec_id long, embedding array<float>, label int"


def made(spark, n=700, d=12, seed=4):
    """Vectors of which a third are equal, with nulls and entries that drop a row, and columns of clashing names."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d)).astype(np.float32) * np.linspace(0.3, 3, d, dtype=np.float32)
    base[: n // 3] = base[0]
    rows = [(i, [float(v) for v in base[i]], int(i % 5) if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 2), (n + 2, [None, *rows[0][1][1:]], 1), (n + 3, [math.nan, *rows[0][1][1:]], 1), (n + 4, [math.inf, *rows[0][1][1:]], 1), (n + 5, [1.0] * (d - 1), 1)]
    rows += [(3, rows[5][1], 4), (None, rows[6][1], None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("x", "id", "n", "rows", "weight", "name", "code", "error", "digest"):
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df, [r for r in rows if r[1] and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_whitening_against_numpy(spark):
    df, kept = made(spark)
    got = whitening.whiten(df).collect()
    assert len(got) == len(kept)
    e = np.array([r[1] for r in kept], np.float64)
    x = np.floor(64 * e).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    w, a = np.linalg.eigh(v)
    w, a = w[::-1], a[:, ::-1]
    plain = y @ (a / np.sqrt(w))
    by = {}
    for r, p, dev in zip(kept, plain, ((n * x - s) ** 2).sum(1), strict=True):
        by.setdefault(r[0], []).append((int(dev), p))
    signs = None
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert np.allclose(r["explained"], w / np.trace(v), rtol=1e-9)
        mine = np.array(r["whitened"])
        p = min(by[r["vec_id"]], key=lambda q: abs(q[0] - r["deviation"]))
        assert r["deviation"] == p[0]
        assert np.allclose(np.abs(mine), np.abs(p[1]), atol=1e-9)
        if r["vec_id"] == 400:
            signs = np.sign(mine * p[1])
    for r in got:
        p = min(by[r["vec_id"]], key=lambda q: abs(q[0] - r["deviation"]))
        assert np.allclose(np.array(r["whitened"]) * signs, p[1], atol=1e-9)
    each = whitening.by_component(whitening.whiten(df)).where("vec_id = 400").collect()
    assert sorted(r["component"] for r in each) == list(range(1, 13))


def test_hot_vector_is_whitened_once(spark, monkeypatch):
    df, kept = made(spark, 600, 8)
    x = vectors.integers(df, "embedding", 64, 0, ["vec_id"])
    assert x.count() == len(kept) and x.select("x").distinct().count() < len(kept)
    plan = whitening.whiten(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_whitening_of_few_or_equal_or_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], COLUMNS)
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in whitening.whiten(df).collect()] == [(0, [], [])] * 5
    assert whitening.by_component(whitening.whiten(df)).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.5, 4.0], 0), (2, [0.25, 1.5, 4.0], 0)], COLUMNS)
    got = whitening.whiten(one).collect()
    assert all(len(r["whitened"]) == 1 and abs(abs(r["whitened"][0]) - 1) < 1e-12 for r in got)


def test_whitening_of_huge_entries(spark):
    df = spark.createDataFrame([(i, [float(10.0 ** (i + 9)), float(-i), 3e38 if i == 3 else 1.0], 0) for i in range(6)], COLUMNS)
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and any(r["deviation"] is None for r in got)  # beyond 64 bits


def plain_codes(kept, parts=4, rounds=4):
    rows = order(kept)
    d = len(rows[0][1])
    x = [[math.floor(1024 * v) for v in r[1]] + [0] * (-d % parts) for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:256]] for c in cut]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut[p]:
                got.setdefault(near(v, books[p])[1], []).append(v)
            for e, vs in got.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    final = [[near(v, books[p]) for v in cut[p]] for p in range(parts)]
    out = [("".join(f"{final[p][i][1]:02x}" for p in range(parts)), sum(final[p][i][0] for p in range(parts))) for i in range(len(rows))]
    return rows, out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def check_codes(spark, df, kept):
    rows, want, sha = plain_codes(kept)
    coded, books = codebooks.codes(df)
    assert codebooks.digest(books) == sha
    labels = {}
    for r, (_, e) in zip(rows, want, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in codebooks.with_label_error(coded).collect())
    assert got == sorted((str(r[0]), c, e, labels[r[2]]) for r, (c, e) in zip(rows, want, strict=True))


def test_codes_against_plain(spark):
    df, kept = made(spark)
    check_codes(spark, df, kept)


def test_codes_of_few_rows_and_lengths_that_need_zeros(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-2, 2) for _ in range(7)], i % 2) for i in range(20)]
    rows = [(i, [float(np.float32(v)) for v in e], x) for i, e, x in rows]
    check_codes(spark, spark.createDataFrame(rows, COLUMNS), rows)
    coded, books = codebooks.codes(spark.createDataFrame([], COLUMNS))
    assert codebooks.with_label_error(coded).count() == 0 and books == []


def test_codes_of_huge_and_tiny_entries(spark):
    rows = [(i, [float(np.float32(10.0**i)), float(-i), 0.001 * i if i % 2 else 0.0, float(np.float32(-(3.0**i)))], None) for i in range(12)]
    rows = [(i, [float(np.float32(v)) for v in e], x) for i, e, x in rows]
    check_codes(spark, spark.createDataFrame(rows, COLUMNS), rows)


def test_cells_hold_every_nearest_entry():
    r = np.random.default_rng(3)
    book = r.integers(-60, 60, (40, 4))
    x = r.integers(-80, 80, (3000, 4))
    far = ((x[:, None] - book) ** 2).sum(-1)
    for cell in (0, 2, 5, 9):
        c = codebooks.Cells(book, cell)
        entry, least = c.nearest(x)
        assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
    assert max(map(len, codebooks.Cells(book, 2).candidates(np.unique(x >> 2, axis=0)))) < 40


def test_queries_over_a_table(spark, tmp_path):
    df, kept = made(spark, 300, 8)
    df.select("vec_id", "embedding", "label").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert Q.op11_embedding_whitening(spark, str(tmp_path)).count() == 8 * len(kept)
    assert Q.op13_vector_codes(spark, str(tmp_path)).count() == len(kept)
